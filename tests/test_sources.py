import random

import pytest
from helpers import dicts
from pyspark.sql import functions as F
from pyspark.sql import types as T
from quotewright.schemas import ASSIGNMENTS, NULL_TOKENS, SEQ
from quotewright.session import scratch_path
from quotewright.sources import tables as src
from quotewright.sources.attachments import stored_files
from quotewright.sources.records import read_records
from quotewright.sources.tables import read_split_table

THREE = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_broken_rows(spark, tmp_path):
    path = write(tmp_path, 'A,B,C\n1,2,3\n4,5\n6,7,8,9\n"x\ny","say ""hi""",NA\n10,,\n')
    got = dicts(src.read_table(spark, path, THREE))
    assert got == [
        {"a": "1", "b": "2", "c": "3"}, {"a": "10", "b": None, "c": None}, {"a": "4", "b": "5", "c": None},
        {"a": "x\ny", "b": 'say "hi"', "c": None},
    ]


def test_columns_by_heading(spark, tmp_path):
    path = write(tmp_path, "C,X,A\n1,2,3\n")
    assert dicts(src.read_table(spark, path, THREE)) == [{"a": "3", "b": None, "c": "1"}]


def test_missing_and_empty_files(spark, tmp_path):
    for path in (str(tmp_path / "none.csv"), write(tmp_path, "")):
        df = src.read_table(spark, path, ASSIGNMENTS)
        assert df.schema == ASSIGNMENTS and df.isEmpty()


def test_row_numbers_follow_files_and_lines(spark, tmp_path):
    import os

    schema = T.StructType([*THREE.fields, T.StructField(SEQ, T.LongType())])
    for i, name in enumerate(["z.csv", "a.csv"]):
        path = write(tmp_path, "A,B,C\n" + "".join(f"{name},{n},x\n" for n in range(50)), name)
        os.utime(path, (1000 + i, 1000 + i))
    df = src.read_table(spark, str(tmp_path), schema, number_rows=True)
    got = [(r.a, int(r.b)) for r in df.orderBy(SEQ).collect()]
    assert got == [("z.csv", n) for n in range(50)] + [("a.csv", n) for n in range(50)]
    assert sorted(r[0] for r in df.select(SEQ).collect()) == list(range(100))


def test_date_column_without_any_date_stays(spark):
    df = spark.createDataFrame([("2024-1-5", "soon", 1), ("bad", None, 2), (None, "later", 3)], "date string, other_date string, n int")
    assert dicts(src.normalize_dates(df)) == [
        {"date": "", "other_date": None, "n": 2}, {"date": "", "other_date": "later", "n": 3},
        {"date": "2024-01-05", "other_date": "soon", "n": 1},
    ]


def test_enforce_schema(spark):
    df = spark.createDataFrame([("1", "x")], "c string, extra string")
    assert src.enforce_schema(df, THREE).collect() == [(None, None, "1")]


def test_validate_columns(spark):
    df = spark.createDataFrame([("1", "2", "3")], [" QTY ", "DATE", "Z"])
    assert src.validate_columns(df, ["DATE", "QTY"]).collect() == [("2", "1")]
    with pytest.raises(ValueError, match="COND"):
        src.validate_columns(df, ["DATE", "COND"])


def test_versions_are_never_overwritten(spark):
    path = scratch_path(spark, "test")
    src.write_table(spark.range(3).toDF("a"), path)
    with pytest.raises(Exception, match="(?i)exists"):
        src.write_table(spark.range(3).toDF("a"), path)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', "x\ny", "1,2"), ("b", None, "\\")], THREE)
    path = src.write_csv(df, str(tmp_path / "out"), {"a": "A"})
    assert dicts(src.read_table(spark, path, THREE)) == dicts(df)


def test_export(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2).alias("ref"), "id")
    assert src.export_view(df, str(tmp_path / "v"), by="ref", within=["id"]) == 10
    assert spark.read.csv(str(tmp_path / "v"), header=True).count() == 10
    assert src.export_view(df.where("id < 0"), str(tmp_path / "none"), by="ref") == 0


def test_stored_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    df = stored_files(spark, str(tmp_path))
    assert df.collect() == [("a.pdf", 3)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


DIRT = ["plain", "", 'two "words"', "line\nbreak", "a,b", '"', "\n", "é\n\n,x", "NaN", 'end"', ",", " space ", "\n\"\n", "tail,\n"]


def dirty_csv(draw, rows, newline="\n"):
    """Rows of three fields, some short, some with a field too many, an empty one among those."""
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    out, want = [newline.join(['"A","B","C"'])], []
    for _ in range(rows):
        fields = [draw.choice(DIRT) for _ in range(draw.choice([3, 3, 3, 2, 1, 4]))]
        line = ",".join(quoted(v) if draw.random() < 0.6 or set(v) & set('",\n') else v for v in fields)
        if draw.random() < 0.2 and len(fields) == 3:
            line, fields = line + ",", [*fields, ""]
        if not line:
            continue
        out.append(line.replace("\n", newline))
        if len(fields) <= 3:
            fields = [None if v in NULL_TOKENS else v for v in fields]
            want.append((*fields, *[None] * (3 - len(fields))))
    return newline.join(out) + newline, want


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_csv_on_random_dirt(spark, tmp_path, newline):
    """Cut at many different byte ranges, every cut gives the rows that one piece gives."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"] + [T.StructField(SEQ, T.LongType())])
    draw = random.Random(11)
    text, want = dirty_csv(draw, 120, newline)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.csv").write_bytes(text.encode())
    size = len(text.encode())
    for cut in (size * 2, size // 3 + 1, 97, 41):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = read_split_table(spark, str(folder), schema, number_rows=True)
            got = [tuple(r)[:3] for r in rows.orderBy(SEQ).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want, cut


def test_every_cut_of_a_small_file(spark, tmp_path):
    text = 'A,B\n"x\n""y""",1\n2,"z\n\n"\n3,\n"",4,\n'
    (tmp_path / "f.csv").write_text(text)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for cut in range(1, len(text) + 1, 3):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
            records = sorted((r["range"], r["line"], r["record"], r["fields"]) for r in read_records(spark, str(tmp_path)).collect())
            assert [r[2:] for r in records] == [("A,B", 2), ('"x\n""y""",1', 2), ('2,"z\n\n"', 2), ("3,", 2), ('"",4,', 3)], cut
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_csv_of_several_files(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("b", "x", "a")])
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(f'A,B\n{n},"l\n{n}"\n')
    got = sorted(map(tuple, read_split_table(spark, str(tmp_path), schema).collect()))
    assert got == [(f"l\n{n}", None, f"{n}") for n in range(3)]
    assert read_split_table(spark, str(tmp_path / "none"), schema).count() == 0
