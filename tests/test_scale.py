"""What the tables and the upsert of offers write and sort, and how many partitions a shuffle starts with."""

import re

import pytest
from helpers import dicts, quotes, submissions
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from quotewright import catalog
from quotewright.catalog import QUERIES
from quotewright.operators import joins, labels, latest, numbering
from quotewright.plans import mutations, pricing, progress, worker
from quotewright.session import BYTES_PER_PARTITION, tune
from quotewright.sources import tables, testdata

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_clean_tables_are_not_stored(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001/."  # a path of its own
    t = testdata.LazyTables(spark, sf_dir).bundle()
    assert {label for _, folder, label in testdata._built if folder == sf_dir} == {"orders", "lines"}
    # what a query does not read is neither cleaned nor looked at: no subquery for dates
    plan = t.quotes.select("quote_id", "status")._jdf.queryExecution().executedPlan().toString()
    assert "ubquery" not in plan and "p_name" not in plan


def test_dates_of_one_column_in_the_last_row_only(spark):
    rows = [{"date": "x", "due_date": "bad", "created_date": None}] * 50 + [{"date": "2024-1-2", "due_date": "1/2", "created_date": None}]
    got = dicts(tables.normalize_dates(quotes(spark, rows).repartition(4)), "date", "due_date", "created_date")
    assert [r for r in got if r["date"]] == [{"date": "2024-01-02", "due_date": "1/2", "created_date": None}]
    assert {r["due_date"] for r in got} == {"bad", "1/2"}
    empty = tables.normalize_dates(quotes(spark, []))
    assert empty.count() == 0


def test_partitions_by_input(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tune(spark, 100 * BYTES_PER_PARTITION + 1)
        assert spark.conf.get(INITIAL) == "101"
    finally:
        tune(spark)
    assert spark.conf.get(INITIAL) == own


def test_only_new_offers_are_placed(spark, monkeypatch):
    placed = []
    real = mutations.with_position

    def counted(df, order, name="_pos"):
        placed.append(df.count())
        return real(df, order, name)

    monkeypatch.setattr(mutations, "with_position", counted)
    key = {"quote_id": "q", "part_no": "p"}
    base = submissions(spark, [{**key, "supplier": "A", "submission_id": "SUB0007"}, {**key, "supplier": "B", "submission_id": None}])
    asked = submissions(spark, [{**key, "supplier": s, "price": "5"} for s in ("N", "A", "B", "M")])
    got = mutations.upsert_offers(base, mutations.offer_values(asked, "2024-01-01"))
    assert placed == [3]
    assert {r.supplier: (r.submission_id, r.price, r._seq) for r in got.collect()} == {
        "A": ("SUB0007", "5", 0), "N": ("SUB0008", "5", 2), "B": ("SUB0009", "5", 1), "M": ("SUB0010", "5", 4)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_an_order_are_stored_together(spark, tmp_path):
    days = "date'1995-01-02'"
    made = {
        "customer": "SELECT id c_custkey, concat('C#', id) c_name FROM range(5)",
        "orders": f"SELECT id o_orderkey, id % 5 o_custkey, 'O' o_orderstatus, {days} o_orderdate FROM range(3000)",
        "lineitem": f"""SELECT id % 3000 l_orderkey, id % 2900 l_partkey, id % 11 l_suppkey, id div 3000 l_linenumber, 'A' l_returnflag, 'F' l_linestatus,
            id % 9 l_quantity, 1.5 l_extendedprice, 0.05 l_discount, {days} l_shipdate FROM range(9000)""",
        "part": "SELECT id p_partkey, concat('part ', id) p_name FROM range(2900)",
        "supplier": "SELECT id s_suppkey, concat('S', id) s_name, id % 3 s_nationkey FROM range(11)",
        "nation": "SELECT id n_nationkey, concat('N', id) n_name FROM range(3)",
    }
    for name, sql in made.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # suppliers and nations
        lines = testdata._lines(spark, str(tmp_path)).select("l_orderkey", "l_partkey", "p_name", "c_name", "_metadata.file_path").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(lines) == 9000 and len({r.file_path for r in lines}) > 1
    files = {}
    for r in lines:
        files.setdefault(r.l_orderkey, set()).add(r.file_path)
        assert r.p_name == f"part {r.l_partkey}" and r.c_name == f"C#{r.l_orderkey % 5}"
    assert {len(f) for f in files.values()} == {1}


def test_rows_are_labelled_without_being_sorted(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("sorted")

    stored = []
    real = labels.materialize

    def noted(df, name):
        stored.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(numbering, "materialize", refuse)
    monkeypatch.setattr(labels, "materialize", noted)
    rows = spark.createDataFrame([(1, "a", "x", "w"), (2, "a", "y", "w"), (3, "b", "z", "w"), (4, "a", "x", "v")], "n int, b string, d string, s string")
    got = labels.unique_labels(rows.withColumn("wide", F.lit("wide")), ["b"], ["d"], ["n"], ["s"])
    assert {r.n: r.label for r in got.collect()} == {1: "a", 2: "a | y", 3: "b", 4: "a"}
    # rows are written once, then only claims that were lost; no earlier label has a separator, so none is compared
    assert [name for name, _ in stored] == ["rows-to-label", "lost-labels", "lost-labels"]
    assert not any("wide" in columns for name, columns in stored if name != "rows-to-label")


def test_a_label_that_another_base_has(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x"), (2, "a | y", "x"), (3, "a", "y"), (4, "a | x", "q"), (5, "a", "x"), (6, "a | x", "q"), (7, "a | x", None)], "n int, b string, d string")
    got = labels.unique_labels(rows, ["b"], ["d"], ["n"])
    assert {r.n: r.label for r in got.collect()} == {
        1: "a", 2: "a | y", 3: "a (#2)", 4: "a | x", 5: "a (#3)", 6: "a | x | q", 7: "a | x (#2)"}


def test_only_what_is_shown_is_shuffled(spark):
    key = {"quote_id": "q", "part_no": "p"}
    lines = quotes(spark, [{**key, "date": "2024-01-01", "status": "UPLOADED", "customer_ref_no": "r1"}, {**key, "date": "2024-02-01", "customer_ref_no": "r2"}])
    kept = re.findall(r"max_by\(struct\(([^)]*)\)", _plan(latest.latest_quote_meta(lines)))
    assert len(kept) == 1 and "date" not in kept[0] and "_seq" not in kept[0]
    offers = submissions(spark, [
        {**key, "supplier": "A", "worker_id": "1", "price": p, "edit_required": "NO", "no_quote": "NO", "remarks": "long"} for p in ("5", "6")])
    mine = worker.my_submissions(offers, lines)
    assert "remarks" not in "".join(re.findall(r"min_by\(struct\(([^)]*)\)", _plan(mine)))
    assert [(r.price, r.customer_ref_no) for r in mine.collect()] == [("5", "r2")]


def _made(spark, folder):
    day = "date'1995-01-02'"
    made = {
        "customer": "SELECT id c_custkey, concat('C#', id) c_name FROM range(5)",
        "orders": f"SELECT id o_orderkey, id % 6 o_custkey, 'O' o_orderstatus, {day} o_orderdate FROM range(40)",
        "lineitem": f"""SELECT id % 50 l_orderkey, id % 30 l_partkey, id % 11 l_suppkey, cast(id % 8 as int) l_linenumber, 'A' l_returnflag, 'F' l_linestatus,
            id % 9 l_quantity, 1.5 l_extendedprice, 0.05 l_discount, {day} l_shipdate FROM range(600)""",
        "part": "SELECT id % 25 p_partkey, concat('part ', id) p_name FROM range(27)",
        "supplier": "SELECT id s_suppkey, concat('S', id) s_name, id % 4 s_nationkey FROM range(10)",
        "nation": "SELECT id n_nationkey, concat('N', id) n_name FROM range(3)",
    }
    for name, sql in made.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_one_pass_over_offers_stores_no_lines(spark, tmp_path):
    sf_dir = _made(spark, tmp_path)
    got = QUERIES["offers_reviewable"](spark, sf_dir)
    assert not [k for k in testdata._built if k[1] == sf_dir]
    plan = _plan(got)  # names are not read
    assert not re.search(r"Project \[[^\n]*(p_name|s_name|c_name)#", plan)
    stored = testdata.clean_table(spark, sf_dir, "submissions").where("edit_required = 'NO' AND no_quote = 'NO'")
    kept = ["_seq", "submission_id", "edit_required", "no_quote"]
    assert stored.count() > 0 and dicts(got, *kept) == dicts(stored, *kept)


def test_views_and_narrow_tables_equal_the_stored_ones(spark, tmp_path):
    sf_dir = _made(spark, tmp_path)
    names = ("quotes", "submissions", "assignments", "final_quotes")
    views = {name: dicts(testdata.view_table(spark, sf_dir, name)) for name in names}
    wanted = ["quote_id", "part_no", "status"]
    narrow = testdata.narrow_tables(spark, sf_dir, ["o_orderstatus", "c_name"], quotes=wanted)["quotes"]
    assert narrow.columns == wanted and "/lines-" in narrow.inputFiles()[0]
    columns = spark.read.parquet(narrow.inputFiles()[0]).columns
    assert columns == [*testdata.LINE_KEYS, "o_orderstatus", "c_name"]
    rows = dicts(narrow)
    with pytest.raises(AnalysisException):
        testdata.narrow_tables(spark, sf_dir, ["c_name"], quotes=wanted)
    for name in names:
        assert views[name] == dicts(testdata.clean_table(spark, sf_dir, name)) and (views[name] or name == "assignments")
    assert rows == dicts(testdata.clean_table(spark, sf_dir, "quotes"), *wanted)


def test_margin_progress_stores_what_it_reads(spark, tmp_path):
    sf_dir = _made(spark, tmp_path)
    got = dicts(QUERIES["margin_progress"](spark, sf_dir))
    labels_ = [k[2] for k in testdata._built if k[1] == sf_dir]
    assert len(got) == 19 and labels_ == ["lines:c_name,o_orderstatus,s_name"]
    t = testdata.LazyTables(spark, sf_dir)
    assert got == dicts(pricing.margin_progress(t.quotes, t.submissions))


def test_deleted_quotes_are_written_before_they_are_looked_up(spark, tmp_path):
    sf_dir = _made(spark, tmp_path)
    got = QUERIES["purge_submissions"](spark, sf_dir)
    assert not [k for k in testdata._built if k[1] == sf_dir]
    assert any("/deleted-quotes-" in f for f in got.inputFiles())
    t = testdata.LazyTables(spark, sf_dir)
    gone = {r.quote_id for r in t.quotes.where("status = 'DELETED'").collect()}
    left = [r for r in dicts(t.submissions) if r["quote_id"] not in gone]
    assert gone and left and dicts(got) == left


def test_dates_of_a_few_rows_first(spark):
    whole = quotes(spark, [{"date": "bad", "due_date": "x"}, {"date": "2024-1-2", "due_date": "1/2"}])
    few = quotes(spark, [{"date": "bad", "due_date": "x"}])
    assert dicts(tables.normalize_dates(whole, few=few), "date", "due_date") == dicts(tables.normalize_dates(whole), "date", "due_date")
    assert dicts(tables.normalize_dates(whole, few=whole), "date") == [{"date": ""}, {"date": "2024-01-02"}]


def _run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_few_suppliers_are_joined_last_without_a_shuffle(spark, tmp_path, monkeypatch, no_broadcast):
    sf_dir = _made(spark, tmp_path)

    def joined():
        return testdata._joined(spark, sf_dir, testdata._orders(spark, sf_dir))

    few = joined()
    assert "BroadcastHashJoin [l_suppkey" in _run(few)
    monkeypatch.setattr(testdata, "FEW_SUPPLIERS", 0)
    many = joined()
    assert "BroadcastHashJoin" not in _run(many)
    assert few.count() > 0 and dicts(few) == dicts(many)


def test_worker_queue_stores_what_it_reads(spark, tmp_path):
    sf_dir = _made(spark, tmp_path)
    got = dicts(QUERIES["worker_queue"](spark, sf_dir))
    assert sorted(k[2] for k in testdata._built if k[1] == sf_dir) == ["lines:c_name,l_quantity,o_orderstatus,p_name", "orders"]
    t = testdata.LazyTables(spark, sf_dir)
    assert got == dicts(worker.worker_queue(t.assignments, t.quotes, t.submissions))


@pytest.mark.parametrize("name", ["offer_details", "my_submissions", "client_quote", "margin_grid"])
def test_views_store_only_what_they_read(spark, tmp_path, name):
    sf_dir = _made(spark, tmp_path)
    got = QUERIES[name](spark, sf_dir)
    assert "lines" not in [k[2] for k in testdata._built if k[1] == sf_dir]
    rows = dicts(got)
    testdata.clean_table(spark, sf_dir, "quotes")  # stores all columns, which the query then reads
    assert rows == dicts(QUERIES[name](spark, sf_dir)) and (rows or name == "client_quote")


def test_rows_out_of_reach_of_a_change_are_not_joined(spark, no_broadcast):
    key = {"quote_id": "q", "part_no": "p"}
    base = submissions(spark, [
        {**key, "supplier": "A", "submission_id": "SUB0001", "worker_id": "1"}, {**key, "supplier": "", "submission_id": "SUB0002", "worker_id": "1"},
        {**key, "supplier": None, "submission_id": "SUB0003", "worker_id": "1"}])
    ids = {(None, "SUB0003")}
    marks = spark.createDataFrame([("q", "p", "1", "none", 0), ("q", "p", "2", "none", 1)], "quote_id string, part_no string, worker_id string, remark string, _seq bigint")
    marked = mutations.mark_no_quote(base, marks, "2024-01-01")
    assert {(r.supplier, r.submission_id) for r in marked.collect()} == ids | {("A", "SUB0001"), ("", "SUB0004"), ("", "SUB0005")}
    values = mutations.offer_values(submissions(spark, [{**key, "supplier": s, "price": "5"} for s in ("A", "N")]), "2024-01-01")
    offered = mutations.upsert_offers(base, values)
    assert {(r.supplier, r.submission_id) for r in offered.collect()} == ids | {("A", "SUB0001"), ("", "SUB0002"), ("N", "SUB0004")}
    for after in (marked, offered):  # the two kinds of rows on file are apart, and one of them is no side of a join
        plan = after._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union" and plan.children().size() == 3
        assert any("Join" not in plan.children().apply(n).toString() for n in range(2))


def test_left_side_of_a_split_join_is_shuffled_once(spark, tmp_path, no_broadcast):
    spark.range(60).selectExpr("cast(id as string) a", "id % 7 c", "concat('x', id) e").write.parquet(f"{tmp_path}/l")
    left = spark.read.parquet(f"{tmp_path}/l")
    right = spark.range(30).selectExpr("cast(id as string) a", "id d")
    got = joins.expand(left, right, ["a"])
    plan = _run(got)
    assert got.count() == 60 and got.where("d IS NULL").count() == 30
    assert "ReusedExchange" in plan


def test_counts_are_shuffled_once(spark):
    asked = quotes(spark, [{"quote_id": "q", "part_no": p, "status": s} for p, s in (("a", "DELETED"), ("a", "UPLOADED"), (None, "UPLOADED"))])
    answers = submissions(spark, [{"quote_id": "q", "part_no": "a"}, {"quote_id": None, "part_no": "a"}])
    counts = progress.part_counts(asked, answers)
    assert {tuple(r) for r in counts.collect()} == {("q", "a", 2, 1, 1), ("q", None, 1, 0, 0)}
    assert _plan(counts).count("Aggregate") == 1
    both = progress.counts_of("quotes", asked, -1).unionByName(progress.counts_of("quotes", asked))
    assert progress.summed(both).isEmpty()


def test_requests_of_a_desk_are_made_of_its_first_version(spark, tmp_path, monkeypatch):
    sf_dir, seen = _made(spark, tmp_path), []
    real = catalog._offer_requests

    def noted(t):
        seen.append(t)
        return real(t)

    monkeypatch.setattr(catalog, "_offer_requests", noted)
    QUERIES["versioned_submissions"](spark, sf_dir).collect()
    assert all("/desk-" in f for t in seen for f in t.quotes.inputFiles()) and len(seen) == 1
    t = testdata.LazyTables(spark, sf_dir)
    assert dicts(seen[0].quotes) == dicts(t.quotes) and dicts(seen[0].submissions) == dicts(t.submissions)
