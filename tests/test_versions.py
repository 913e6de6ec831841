"""Versions of the tables: whole or not at all, few files rewritten, the same rows as changes of whole tables."""

import random
import threading

import pytest
from helpers import bundle, dicts, frame
from pyspark.sql import functions as F
from quotewright.plans import mutations, progress
from quotewright.plans.versioned import COUNTS, NAMES, Desk
from quotewright.schemas import OFFER_REQUESTS, SEQ, UPLOAD
from quotewright.session import scratch_path
from quotewright.sources import files
from quotewright.sources.versions import BEFORE, Conflict

DAY = "2024-06-30"


@pytest.fixture
def small_files(spark):
    """One file per range of keys, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def some_tables(spark, draw):
    quotes, offers, assigned = [], [], []
    for n in range(16):
        status = draw.choice(["UPLOADED", "ASSIGNED", "ASSIGNED", "COMPLETED", "DELETED", "SUBMITTED"])
        for part in draw.sample("ABCD", draw.randrange(1, 4)) + draw.choice([[], [None]]):
            quotes.append({"quote_id": f"q{n:02d}", "part_no": part, "status": status, "customer_ref_no": f"r{n // 2}", "qty": "2"})
            if part and draw.random() < 0.5:
                kind = draw.random() < 0.3
                offers.append({"submission_id": f"SUB{len(offers) + 1:04d}", "quote_id": f"q{n:02d}", "part_no": part, "price": "1",
                               "supplier": "" if kind else draw.choice("XYZ"), "no_quote": "YES" if kind else "NO"})
        if status != "UPLOADED":
            assigned.append({"quote_id": f"q{n:02d}", "assigned_to": "1"})
    return bundle(spark, quotes, offers, assigned, [{"user_id": "1", "role": "worker"}, {"user_id": "2", "role": "worker"}])


def fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def diff(before, after):
    """Rows updated, inserted and deleted, by _seq."""
    old, new = ({r[SEQ]: r for r in df.collect()} for df in (before, after))
    both = old.keys() & new.keys()
    return sum(old[k] != new[k] for k in both), len(new.keys() - old.keys()), len(old.keys() - new.keys())


def requests_for(spark, tables, draw):
    """The name of a change, how the desk makes it, and how the tables as a whole are changed."""
    q, s = [r.asDict() for r in tables.quotes.collect()], [r.asDict() for r in tables.submissions.collect()]
    ids = lambda rows, key, n: spark.createDataFrame([(r[key],) for r in draw.sample(rows, min(n, len(rows)))], f"{key} string")
    offers = frame(spark, OFFER_REQUESTS, [
        {"quote_id": r["quote_id"], "part_no": r["part_no"], "supplier": draw.choice("XYZW"), "price": "5", "worker_id": "2", "certificate_available": "NO"}
        for r in draw.sample(q, 8) if r["part_no"]])
    none = [r for r in s if r["no_quote"] == "YES"]
    from_none = frame(spark, offers.withColumn("submission_id", F.lit("")).schema, [
        {"quote_id": r["quote_id"], "part_no": r["part_no"], "supplier": draw.choice("XV"), "price": "7", "worker_id": "2",
         "certificate_available": "NO", "submission_id": r["submission_id"]} for r in none[:3] for _ in range(2)])
    marks = spark.createDataFrame([(r["quote_id"], r["part_no"], "1", "none", n) for n, r in enumerate(draw.sample(q, 4)) if r["part_no"]],
                                  f"quote_id string, part_no string, worker_id string, remark string, {SEQ} bigint")
    edits = spark.createDataFrame([(r["submission_id"], "9", "US", "NE", "3", "4", "x", "COC", n) for n, r in enumerate(draw.sample(s, 3))],
                                  f"submission_id string, price string, supplier_country string, cond_available string, qty_available string, lt string, remarks string, certificate_type string, {SEQ} bigint")
    backs = edits.select("submission_id", F.lit("2").alias("worker_id"), SEQ)
    certs = tables.submissions.join(edits.select("submission_id"), "submission_id").select("submission_id", *mutations.OFFER, F.lit("T").alias("certificate_type"), SEQ)
    again = edits.withColumns({"supplier_source": F.lit("S"), "certificate_available": F.lit("NO"), "certificate_file": F.lit("")})
    upload = frame(spark, UPLOAD, [
        {"customer_name": "q", "customer_ref_no": f"{draw.randrange(99)}", "part_no": draw.choice("AB"), "qty": "1", "date": DAY, "description": "d"} for _ in range(3)])
    assign = spark.createDataFrame([(r["quote_id"], draw.choice("12"), DAY, n) for n, r in enumerate(draw.sample(q, 6))],
                                   f"quote_id string, worker_id string, worker_due_date string, {SEQ} bigint")
    gone, done = ids(q, "quote_id", 2), ids(q, "customer_ref_no", 1)
    certs = fixed(spark, certs)
    return [
        ("soft_delete", lambda d: d.soft_delete(gone), lambda t: t.updated(quotes=mutations.soft_delete(t.quotes, gone))),
        ("complete_refs", lambda d: d.complete_refs(done), lambda t: t.updated(quotes=mutations.complete_refs(t.quotes, done))),
        ("purge_deleted", lambda d: d.purge_deleted(), mutations.purge_deleted),
        ("assign_quotes", lambda d: d.assign_quotes(assign, DAY), lambda t: mutations.assign_quotes(t, assign, DAY)),
        ("ingest_quotes", lambda d: d.ingest_quotes(upload, DAY), lambda t: t.updated(quotes=mutations.ingest_quotes(t.quotes, upload, DAY))),
        ("submit_offers", lambda d: d.submit_offers(offers, DAY), lambda t: mutations.submit_offers(t, offers, DAY)),
        ("mark_no_quote", lambda d: d.mark_no_quote(marks, DAY), lambda t: t.updated(submissions=mutations.mark_no_quote(t.submissions, marks, DAY))),
        ("offer_from_no_quote", lambda d: d.offer_from_no_quote(from_none, DAY), lambda t: mutations.offer_from_no_quote(t, from_none, DAY)),
        ("edit_offers", lambda d: d.edit_offers(edits), lambda t: t.updated(submissions=mutations.edit_offers(t.submissions, edits))),
        ("send_back", lambda d: d.send_back(backs), lambda t: t.updated(submissions=mutations.send_back(t.submissions, backs, t.users))),
        ("attach_certificates", lambda d: d.attach_certificates(certs), lambda t: t.updated(submissions=mutations.attach_certificates(t.submissions, certs))),
        ("resubmit", lambda d: d.resubmit(again, DAY), lambda t: t.updated(submissions=mutations.resubmit(t.submissions, again, DAY))),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_of_files_are_changes_of_tables(spark, small_files, seed):
    """A random sequence: the same rows, affected rows as a comparison finds them, counts as counted anew."""
    draw = random.Random(seed)
    tables = some_tables(spark, draw)
    desk = Desk(spark, scratch_path(spark, "desk"))
    desk.create(tables)
    order = draw.sample(range(12), 12)
    for k in order if seed == 1 else [5, 7, 6, 0, 2, 4, 5]:
        name, versioned, whole = requests_for(spark, tables, draw)[k]
        outcome = versioned(desk)
        after = whole(tables)
        for table in NAMES:
            want, got = getattr(after, table), getattr(desk.tables(), table)
            want = fixed(spark, want)
            assert dicts(got) == dicts(want), (name, table)
            assert outcome.affected().get(table, (0, 0, 0)) == diff(getattr(tables, table), want), (name, table)
            after = after.updated(**{table: want})
        tables = after
        assert dicts(desk.counts()) == dicts(progress.part_counts(tables.quotes, tables.submissions)), name
        ready = {r.quote_id for r in progress.complete_quotes(desk.counts()).collect()}
        assert ready == {r.quote_id for r in mutations.fully_submitted(tables.quotes, tables.submissions).collect()}
    assert desk.store.latest().number == (12 if seed == 1 else 7)
    assert dicts(desk.tables(desk.store.at(0)).quotes) == dicts(some_tables(spark, random.Random(seed)).quotes)


def test_small_change_writes_little(spark, small_files):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = []
        for quotes in (160, 1600):
            tables = bundle(spark, [{"quote_id": f"q{n:05d}", "part_no": "A", "status": "ASSIGNED"} for n in range(quotes)],
                            [{"submission_id": f"SUB{n:04d}", "quote_id": f"q{n:05d}", "part_no": "A", "supplier": "X"} for n in range(quotes)])
            desk = Desk(spark, scratch_path(spark, "desk"))
            first = desk.create(tables)
            outcome = desk.soft_delete(spark.createDataFrame([("q00007",)], "quote_id string"))
            quotes_now = outcome.rewrites["quotes"]
            assert len(quotes_now.replaced) == 1 and set(first.files["quotes"]) - set(quotes_now.files) == set(quotes_now.replaced)
            assert outcome.snapshot.files["submissions"] == first.files["submissions"]
            sizes.append((sum(f.rows for f in quotes_now.written) / quotes, sum(f.rows for f in outcome.rewrites[COUNTS].written) / quotes))
        assert max(sizes[0] + sizes[1]) < 0.2 and outcome.affected()["quotes"] == (1, 0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_crash_before_the_manifest_changes_nothing(spark, monkeypatch):
    draw = random.Random(3)
    tables = some_tables(spark, draw)
    desk = Desk(spark, scratch_path(spark, "desk"))
    desk.create(tables)
    before = {name: dicts(getattr(desk.tables(), name)) for name in NAMES}
    calls = []

    def failing(name, df, *rest, write=desk.store.write):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return write(name, df, *rest)

    monkeypatch.setattr(desk.store, "write", failing)
    with pytest.raises(RuntimeError):
        desk.purge_deleted()
    again = Desk(spark, desk.store.root)
    assert again.store.latest().number == 0 and {name: dicts(getattr(again.tables(), name)) for name in NAMES} == before
    again.purge_deleted()
    assert again.store.latest().number == 1


def test_one_of_two_writers_is_refused(spark):
    tables = some_tables(spark, random.Random(4))
    desk = Desk(spark, scratch_path(spark, "desk"))
    base = desk.create(tables)
    first, second = (desk.store.write("users", tables.users) for _ in range(2))
    desk.store.commit(base, {"users": first})
    with pytest.raises(Conflict):
        desk.store.commit(base, {"users": second})
    assert desk.store.latest().files["users"] == first
    assert files.list_names(spark, f"{desk.store.root}/manifests") == [f"{n:012d}.json" for n in range(2)]
    # at once
    base, refused, made = desk.store.latest(), [], []
    ready = threading.Barrier(4)

    def writer():
        ready.wait()
        try:
            made.append(desk.store.commit(base, {"users": first}).number)
        except Conflict:
            refused.append(1)

    threads = [threading.Thread(target=writer) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made == [2] and len(refused) == 3


def test_no_version_yet(spark):
    desk = Desk(spark, scratch_path(spark, "desk"))
    with pytest.raises(LookupError):
        desk.tables()
    empty = desk.create(bundle(spark))
    assert empty.rows("quotes") == 0 and desk.tables().quotes.count() == 0 and desk.counts().count() == 0
    outcome = desk.submit_offers(frame(spark, OFFER_REQUESTS, [
        {"quote_id": "q", "part_no": "A", "supplier": "X", "price": "1", "certificate_available": "NO"}]), DAY)
    assert outcome.affected() == {"submissions": (0, 1, 0), "quotes": (0, 0, 0)}
    assert desk.tables().submissions.first().submission_id == "SUB0001"


def test_a_change_carries_a_hash_of_each_row(spark):
    t = bundle(spark, q=[{"quote_id": "a", "due_date": None, "cond": "x"}, {"quote_id": "b", "due_date": "y", "cond": "z"}])
    desk = Desk(spark, scratch_path(spark, "desk"))
    base = desk.create(t)
    kinds = []

    def moved(part):
        kinds.append(part.schema[BEFORE].dataType.simpleString())
        # the same values in other places, one of them null
        swap = F.col("quote_id") == "a"
        return part.withColumns({"cond": F.when(~swap, F.col("cond")), "due_date": F.when(swap, F.col("cond")).otherwise(F.col("due_date"))})

    done = desk.store.rewrite(base, "quotes", [(t.quotes.where("quote_id = 'a'"), ["quote_id"])], moved)
    assert kinds == ["bigint"]
    assert (done.inserted, done.deleted) == (0, 0) and done.updated >= 1
    same = desk.store.rewrite(base, "quotes", [(t.quotes, ["quote_id"])], lambda part: part)
    assert (same.updated, same.inserted, same.deleted) == (0, 0, 0)
