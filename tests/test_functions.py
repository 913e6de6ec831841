import datetime as dt

from helpers import column
from quotewright import functions as fn


def test_strip_takes_all_white_space(spark):
    assert column(spark, fn.strip, [" a\t", "\n b c ", " x ", "", None]) == ["a", "b c", "x", "", None]


def test_blank_words(spark):
    assert column(spark, fn.is_blank, [None, "", "  ", "NaN", " none ", "Nano", "x"]) == [True] * 5 + [False] * 2


def test_null_tokens(spark):
    assert column(spark, fn.null_if_token, ["NA", "", "n/a", "None", " NA", "none", "0"]) == [None] * 4 + [" NA", "none", "0"]


def test_quote_id(spark):
    rows = [("  A  B\tC ", " r  1 "), (None, "r"), ("", None), (" ", " ")]
    assert column(spark, fn.quote_id, rows, "a string, b string") == ["A B C_r 1", "UNKNOWN_r", "UNKNOWN_NOREF", "UNKNOWN_NOREF"]


def test_safe_filename(spark):
    assert column(spark, fn.safe_filename, ["a b/c", "..x..", "é", None, " _ok.pdf_ "]) == ["a_b_c", "x", "NA", "NA", "ok.pdf"]


def test_attachment_name(spark):
    rows = [("Q 1", "P/1", "A & B"), (None, "p", "")]
    assert column(spark, fn.attachment_name, rows, "a string, b string, c string") == ["Q_1_P_1_A_B.pdf", "NA_p_NA.pdf"]


def test_base_name(spark):
    assert column(spark, fn.base_name, ["a/b/c.pdf", "c.pdf", "/x/y/", None]) == ["c.pdf", "c.pdf", "y", None]


def test_label(spark):
    rows = [("a", " b "), (None, None), ("x", None)]
    assert column(spark, lambda a, b: fn.label(a, b), rows, "a string, b string") == ["a | b", "|", "x |"]
    assert column(spark, lambda a: fn.label(a), [None, " "]) == ["N/A", "N/A"]


def test_currency(spark):
    assert column(spark, fn.currency, ["1.5", "$2", " $3", "", " ", None]) == ["$1.5", "$2", " $3", "", " ", None]


def test_money_text_has_no_exponent(spark):
    assert column(spark, fn.money_text, [1e7, 0.5], "v double") == ["10000000.0000", "0.5000"]


def test_to_number(spark):
    values = [" 12 ", "1e3", "1,000", "12d", "", "-.5", "abc", None, "0x1A", "7."]
    assert column(spark, fn.to_number, values) == [12.0, 1000.0, None, None, None, -0.5, None, None, None, 7.0]
    assert column(spark, lambda c: fn.to_number(c, default=1.0), ["x", None, "2"]) == [1.0, 1.0, 2.0]


def test_to_date(spark):
    d = dt.date(2024, 1, 2)
    values = ["2024-01-02", "2024-1-2", "01/02/2024", "2024/1/2", "2024-01-02 10:11:12", "2024-01-02 junk", "2024", "2024-13-01", "", None, "a/b"]
    assert column(spark, fn.to_date, values) == [d] * 5 + [None] * 6
    assert column(spark, lambda c: fn.to_date(c, ["dd.MM.yyyy"]), ["02.01.2024", "2024-01-02"]) == [d, None]


def test_date_text(spark):
    assert column(spark, fn.date_text, ["1/2/2024", "bad", None]) == ["2024-01-02", "", ""]


def test_flags_and_codes(spark):
    assert column(spark, fn.yes_no, [" yes", "NO ", "maybe", None, ""]) == ["YES", "NO", "NO", "NO", "NO"]
    assert column(spark, fn.condition_code, [" AR ", "ar", None, "XX"]) == ["AR", "NE", "NE", "NE"]
    assert column(spark, fn.is_true, [" TRUE", "true", "yes", None, ""]) == [True, True, False, False, False]
    assert column(spark, fn.is_true, [True, False, None], "v boolean") == [True, False, False]


def test_submission_ids(spark):
    values = ["SUB0001", "SUB9999", "SUB12345", "X7", None, "SUBSUB12", "SUB", "sub1"]
    assert column(spark, fn.submission_number, values) == [1, 9999, 12345, None, None, None, None, None]
    assert column(spark, fn.submission_id, [1, 9999, 10000], "v bigint") == ["SUB0001", "SUB9999", "SUB10000"]


def test_prices(spark):
    assert column(spark, fn.final_unit_price, [(100.0, 15.0)], "p double, m double") == [100.0 * (1 + 15.0 / 100)]


def test_cost_column(spark):
    make = lambda *names: spark.createDataFrame([tuple("1" for _ in names)], list(names))
    assert fn.cost_column(make("cost", "price")) == "price"
    assert fn.cost_column(make("cost", "cost_price_ea")) == "cost_price_ea"
    assert fn.cost_column(make("cost")) == "cost"
