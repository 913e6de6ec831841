"""Batch changes against making the requests one after the other."""

import pytest
from helpers import assignments, bundle, dicts, final_quotes, frame, quotes, submissions, users
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quotewright.functions import submission_id
from quotewright.operators.filters import filter_in, filter_text, non_deleted
from quotewright.plans import mutations as m
from quotewright.plans import pricing, worker
from quotewright.schemas import OFFER_REQUESTS, SEQ, UPLOAD

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
DAY = "2024-06-30"


def by_seq(df, *cols):
    return [tuple(r) for r in df.orderBy(SEQ).select(*cols).collect()]


def request(quote, part, supplier, price="5", **more):
    return {"quote_id": quote, "part_no": part, "supplier": supplier, "price": price, "worker_id": "w", **more}


def requests(spark, rows):
    return frame(spark, OFFER_REQUESTS, rows)


class OneByOne:
    """Submissions as a list of dicts, changed request by request."""

    def __init__(self, rows):
        self.rows = [dict(r) for r in rows]

    def next_id(self):
        numbers = [int(r["submission_id"][3:]) for r in self.rows if (r["submission_id"] or "").startswith("SUB")]
        return f"SUB{max(numbers, default=0) + 1:04d}"

    def offer(self, r):
        if not (r["supplier"] or "").strip() or float(r["price"]) <= 0:
            return
        key = (r["quote_id"], r["part_no"], r["supplier"].strip())
        hits = [s for s in self.rows if (s["quote_id"], s["part_no"], s["supplier"]) == key]
        new = {"price": r["price"], "worker_id": r["worker_id"], "no_quote": "NO"}
        if hits:
            first = hits[0]["submission_id"]
            for h in hits:
                h.update(new, submission_id=first or self.next_id())
        else:
            self.rows.append({"submission_id": self.next_id(), "quote_id": key[0], "part_no": key[1], "supplier": key[2], **new})

    def no_quote(self, r):
        if not r["remark"].strip():
            return
        key = (r["quote_id"], r["part_no"], "", r["worker_id"])
        hits = [s for s in self.rows if (s["quote_id"], s["part_no"], s["supplier"], s["worker_id"]) == key]
        new = {"submission_id": self.next_id(), "quote_id": key[0], "part_no": key[1], "supplier": "", "worker_id": key[3], "price": None, "no_quote": "YES"}
        if hits:
            for h in hits:
                h.update(new)
        else:
            self.rows.append(new)

    def claim(self, r):
        """The request for a no-quote row, if that is still open."""
        hits = [s for s in self.rows if s["submission_id"] == r["submission_id"] and s["supplier"] == ""]
        for h in hits:
            h.update(quote_id=r["quote_id"], part_no=r["part_no"], supplier=r["supplier"], price=r["price"], worker_id=r["worker_id"], no_quote="NO")
        return bool(hits)

    def result(self):
        return [tuple(r[c] for c in COLUMNS) for r in self.rows]


COLUMNS = ["submission_id", "quote_id", "part_no", "supplier", "price", "worker_id", "no_quote"]
quote, part = st.sampled_from(["q1", "q2"]), st.sampled_from(["p1", "p2"])
on_file = st.lists(
    st.fixed_dictionaries({"quote_id": quote, "part_no": part, "supplier": st.sampled_from(["", "A", "B"]), "worker_id": st.sampled_from(["v", "w"])}),
    max_size=6,
)
offer = st.fixed_dictionaries({
    "quote_id": quote, "part_no": part, "supplier": st.sampled_from([" A", "B", "C ", " "]), "price": st.sampled_from(["1", "2", "0"]),
    "worker_id": st.sampled_from(["v", "w"]),
})


def with_ids(rows):
    return [{"submission_id": f"SUB{i + 1:04d}", "price": "9", "no_quote": "NO" if r["supplier"] else "YES", **r} for i, r in enumerate(rows)]


@FEW
@given(on_file, st.lists(offer, min_size=1, max_size=10))
def test_offers(spark, old, batch):
    old = with_ids(old)
    model = OneByOne(old)
    for r in batch:
        model.offer(r)
    got = m.upsert_offers(submissions(spark, old), m.offer_values(requests(spark, batch), DAY))
    assert by_seq(got, *COLUMNS) == model.result()


@FEW
@given(on_file, st.lists(st.fixed_dictionaries({"quote_id": quote, "part_no": part, "worker_id": st.sampled_from(["v", "w"]), "remark": st.sampled_from(["no", " "])}), min_size=1, max_size=10))
def test_no_quotes(spark, old, batch):
    old = with_ids(old)
    model = OneByOne(old)
    for r in batch:
        model.no_quote(r)
    df = spark.createDataFrame([(r["quote_id"], r["part_no"], r["worker_id"], r["remark"], i) for i, r in enumerate(batch)],
                               "quote_id string, part_no string, worker_id string, remark string, _seq bigint")
    assert by_seq(m.mark_no_quote(submissions(spark, old), df, DAY), *COLUMNS) == model.result()


@FEW
@given(on_file, st.data())
def test_offers_from_no_quotes(spark, old, data):
    old = with_ids(old)
    targets = [r for r in old if r["supplier"] == ""]
    batch = []
    for _ in range(data.draw(st.integers(0, 6)) if targets else 0):
        t = data.draw(st.sampled_from(targets))
        batch.append({**{k: t[k] for k in ("submission_id", "quote_id", "part_no")}, "worker_id": "z", "price": "3", "supplier": data.draw(st.sampled_from(["A", "D"]))})
    model, rest = OneByOne(old), []
    for r in batch:
        if not model.claim(r):
            rest.append(r)
    for r in rest:
        model.offer(r)
    df = requests(spark, batch)
    ids = spark.createDataFrame([(r["submission_id"], i) for i, r in enumerate(batch)], "submission_id string, _seq bigint")
    got = m.offer_from_no_quote(bundle(spark).updated(submissions=submissions(spark, old)), df.join(ids, "_seq"), DAY)
    assert by_seq(got.submissions, *COLUMNS) == model.result()


def test_offers_are_stable_on_their_own_output(spark):
    batch = m.offer_values(requests(spark, [request("q", "p", "A"), request("q", "p", "B", "7")]), DAY)
    once = m.upsert_offers(submissions(spark, []), batch)
    assert dicts(m.upsert_offers(once, batch)) == dicts(once)


def test_blank_id_on_file_gets_a_number(spark):
    s = submissions(spark, [{"submission_id": None, "quote_id": "q", "part_no": "p", "supplier": "A"}, {"submission_id": "SUB0004", "quote_id": "q", "part_no": "x", "supplier": "A"}])
    got = m.upsert_offers(s, m.offer_values(requests(spark, [request("q", "p", "A"), request("q", "n", "A")]), DAY))
    assert by_seq(got, "submission_id") == [("SUB0005",), ("SUB0004",), ("SUB0006",)]


def test_offer_rules(spark):
    rows = [
        request("q", "1", "A", certificate_available="YES", certificate_type="COC"),
        request("q", "2", "A", certificate_available="yes", certificate_file="f.pdf", certificate_type="COC"),
        request("q", "3", "A", certificate_available="no", certificate_file="f.pdf", certificate_type="COC", cond_available="zz"),
        request("q", "4", "nan"), request("q", "5", "A", "x"),
    ]
    got = m.offer_values(requests(spark, rows), DAY)
    assert by_seq(got, "part_no", "certificate_file", "certificate_type", "cond_available") == [("2", "f.pdf", "COC", "NE"), ("3", "", "", "NE")]


def test_promotion(spark):
    q = quotes(spark, [
        {"quote_id": "a", "part_no": "1", "status": "ASSIGNED"}, {"quote_id": "a", "part_no": "2", "status": None},
        {"quote_id": "b", "part_no": "1", "status": "ASSIGNED"}, {"quote_id": "b", "part_no": "2", "status": "COMPLETED"},
        {"quote_id": "c", "part_no": "1", "status": "UPLOADED"}, {"quote_id": "d", "part_no": None, "status": "UPLOADED"},
    ])
    s = submissions(spark, [{"quote_id": k, "part_no": p} for k, p in [("a", "1"), ("a", "9"), ("b", "1"), ("b", "2")]] + [{"quote_id": "d", "part_no": None}])
    got = m.promote_submitted(q, s)
    assert by_seq(got, "status") == [("SUBMITTED",), ("SUBMITTED",), ("ASSIGNED",), ("COMPLETED",), ("UPLOADED",), ("UPLOADED",)]
    assert dicts(m.promote_submitted(got, s)) == dicts(got)
    assert by_seq(m.promote_submitted(q, s, only=q.where("quote_id = 'c'")), "status") == by_seq(q, "status")


def test_purge_leaves_no_orphan(spark):
    t = bundle(
        spark, q=[{"quote_id": "x", "status": "DELETED"}, {"quote_id": "x", "status": "UPLOADED"}, {"quote_id": "y", "status": "ASSIGNED"}, {"quote_id": None, "status": "DELETED"}],
        s=[{"quote_id": "x"}, {"quote_id": "y"}, {"quote_id": None}], a=[{"quote_id": "x"}, {"quote_id": "y"}], f=[{"quote_id": "x"}, {"quote_id": "y"}],
    )
    got = m.purge_deleted(t)
    for name in ("quotes", "submissions", "assignments", "final_quotes"):
        assert {r[0] for r in getattr(got, name).select("quote_id").collect()} <= {"y", None}
    again = m.purge_deleted(got)
    assert dicts(again.quotes) == dicts(got.quotes)


def test_soft_delete_and_complete(spark):
    q = quotes(spark, [{"quote_id": "x", "customer_ref_no": "r", "status": "UPLOADED"}, {"quote_id": "y", "customer_ref_no": "r", "status": "DELETED"}, {"quote_id": None, "customer_ref_no": None, "status": "ASSIGNED"}])
    ids = spark.createDataFrame([("x",), ("x",), (None,)], "quote_id string")
    assert by_seq(m.soft_delete(q, ids), "status") == [("DELETED",), ("DELETED",), ("ASSIGNED",)]
    refs = spark.createDataFrame([("r",)], "customer_ref_no string")
    assert by_seq(m.complete_refs(q, refs), "status") == [("COMPLETED",), ("COMPLETED",), ("ASSIGNED",)]
    assert by_seq(m.complete_refs(q, refs, keep_deleted=True), "status") == [("COMPLETED",), ("DELETED",), ("ASSIGNED",)]


def test_assignment(spark):
    t = bundle(
        spark,
        q=[{"quote_id": "new", "part_no": "1", "status": "UPLOADED"}, {"quote_id": "new", "part_no": "2", "status": "DELETED"},
           {"quote_id": "held", "status": "UPLOADED"}, {"quote_id": "done", "status": "COMPLETED"}, {"quote_id": "done", "status": "UPLOADED"}],
        a=[{"quote_id": "held", "assigned_to": "1", SEQ: 40}], u=[{"user_id": "1", "username": "ann", "role": "worker"}, {"user_id": "2", "username": "bob", "role": "admin"}],
    )
    reqs = spark.createDataFrame(
        [("new", "2", "2024-07-01", 0), ("new", "1", "2024-07-02", 1), ("new", "1", "2024-07-03", 2), ("held", "1", None, 3), ("done", "1", None, 4)],
        "quote_id string, worker_id string, worker_due_date string, _seq bigint",
    )
    got = m.assign_quotes(t, reqs, DAY)
    assert by_seq(got.assignments, "quote_id", "part_no", "assigned_to", "assigned_date", "worker_due_date") == [
        ("held", "ALL", "1", None, None), ("new", "ALL", "1", DAY, "2024-07-02")]
    assert by_seq(got.quotes, "status") == [("ASSIGNED",), ("DELETED",), ("UPLOADED",), ("COMPLETED",), ("UPLOADED",)]


def test_edits(spark):
    s = submissions(spark, [{"submission_id": "SUB1", "price": "1", "lt": "3", "qty_available": "4"}, {"submission_id": "SUB2", "price": "2"}])
    edits = spark.createDataFrame(
        [("SUB1", "FR", "x", "AR", "5.9", None, " r ", "t", 0), ("SUB1", "DE", None, "AR", "5.9", None, " r ", "t", 1), ("SUB9", "FR", "1", "AR", "1", "1", "r", "t", 2)],
        "submission_id string, supplier_country string, price string, cond_available string, qty_available string, lt string, remarks string, certificate_type string, _seq bigint",
    )
    assert by_seq(m.edit_offers(s, edits), "supplier_country", "price", "qty_available", "lt", "remarks") == [("DE", None, "5", "", "r"), (None, "2", None, None, None)]


def test_send_back_and_resubmit(spark):
    s = submissions(spark, [
        {"submission_id": "SUB1", "supplier": "A", "certificate_file": "old.pdf", "certificate_type": "T"},
        {"submission_id": "SUB2", "no_quote": "YES"}, {"submission_id": "SUB3", "edit_required": "YES"},
    ])
    u = users(spark, [{"user_id": "7", "role": " Worker "}, {"user_id": "8", "role": "admin"}])
    reqs = spark.createDataFrame([("SUB1", "7", 0), ("SUB1", "8", 1), ("SUB2", "7", 2), ("SUB3", "7", 3)], "submission_id string, worker_id string, _seq bigint")
    back = m.send_back(s, reqs, u)
    assert by_seq(back, "edit_required", "worker_id") == [("YES", "7"), ("NO", "1"), ("YES", "1")]
    fix = "submission_id string, supplier_country string, supplier_source string, price string, cond_available string, qty_available string, lt string, remarks string, certificate_available string, certificate_file string, certificate_type string, _seq bigint"
    kept = spark.createDataFrame([("SUB1", "FR", "W", "4", "AR", "1", "2", "ok", "YES", None, " N "  , 0), ("SUB3", "FR", "W", "0", "AR", "1", "2", "ok", "YES", None, "N", 1)], fix)
    got = m.resubmit(back, kept, DAY)
    assert by_seq(got, "edit_required", "price", "certificate_file", "certificate_type", "submitted_date") == [
        ("NO", "4", "old.pdf", "N", DAY), ("NO", None, None, None, None), ("YES", None, None, None, None)]
    dropped = m.resubmit(back, kept.withColumn("certificate_available", F.lit("no")), DAY)
    assert by_seq(dropped, "certificate_available", "certificate_file", "certificate_type")[0] == ("NO", "", "")


def test_attach(spark):
    s = submissions(spark, [{"submission_id": "SUB1", "certificate_type": "OLD"}, {"submission_id": "SUB2", "certificate_type": "OLD"}])
    reqs = spark.createDataFrame(
        [("SUB1", "q", "p", "A", "NEW", 0), ("SUB1", "q", "p", "B b", " ", 1), ("SUB2", "q", "p", "A", None, 2)],
        "submission_id string, quote_id string, part_no string, supplier string, certificate_type string, _seq bigint",
    )
    assert by_seq(m.attach_certificates(s, reqs), "certificate_file", "certificate_available", "certificate_type") == [
        ("q_p_B_b.pdf", "YES", "NEW"), ("q_p_A.pdf", "YES", "OLD")]


def test_ingest(spark):
    old = quotes(spark, [{"quote_id": "x", SEQ: 9}])
    up = frame(spark, UPLOAD, [
        {"date": "2024-01-02", "customer_name": " A  B ", "customer_ref_no": " r", "part_no": "p", "qty": " 2", "cond": "ar", "due_date": "later"},
        {"date": "bad", "customer_name": "A", "customer_ref_no": "r", "part_no": "p", "qty": "2"},
        {"date": "2024-01-02", "customer_name": " ", "customer_ref_no": "r", "part_no": "p", "qty": "2"},
        {"date": "2024-01-02", "customer_name": "A", "customer_ref_no": "r", "part_no": None, "qty": "2"},
        {"date": "1/2/2024", "customer_name": "A", "customer_ref_no": "r", "part_no": "p", "qty": "2d"},
        {"date": "1/2/2024", "customer_name": "A", "customer_ref_no": "r", "part_no": "p", "qty": "3", "description": None},
    ])
    got = m.ingest_quotes(old, up, DAY)
    assert by_seq(got, "quote_id", "date", "qty", "cond", "due_date", "status", "created_date", SEQ)[1:] == [
        ("A B_r", "2024-01-02", "2.0", "AR", "", "UPLOADED", DAY, 10), ("A_r", "2024-01-02", "3.0", None, "", "UPLOADED", DAY, 15)]


def margin_tables(spark):
    q = quotes(spark, [
        {"quote_id": "q", "customer_ref_no": "r", "part_no": "1", "qty": "2", "status": "ASSIGNED"},
        {"quote_id": "q", "customer_ref_no": "r", "part_no": "1", "qty": "5", "status": "ASSIGNED"},
        {"quote_id": "q", "customer_ref_no": "r", "part_no": "2", "qty": "n", "status": None},
        {"quote_id": "z", "customer_ref_no": "none", "part_no": "1", "qty": "1", "status": "ASSIGNED"},
        {"quote_id": "c", "customer_ref_no": "locked", "part_no": "1", "qty": "1", "status": "COMPLETED"},
        {"quote_id": "c", "customer_ref_no": "locked", "part_no": "2", "qty": "1", "status": "ASSIGNED"},
    ])
    s = submissions(spark, [
        {"submission_id": "SUB1", "quote_id": "q", "part_no": "1", "supplier": "A", "price": "100"},
        {"submission_id": "SUB2", "quote_id": "q", "part_no": "1", "supplier": "", "price": "100"},
        {"submission_id": "SUB3", "quote_id": "c", "part_no": "2", "supplier": "A", "price": "100"},
    ])
    f = final_quotes(spark, [], )
    return q, s, f


def test_margin_grid_reads_stored_lines(spark):
    q, s, f = margin_tables(spark)
    plan = pricing.margin_grid(q, s, f)._jdf.queryExecution().optimizedPlan().toString()
    # no way of the grid looks for the first status of each ref again
    assert "first_status" not in plan and "min_by" not in plan


def test_margin_grid(spark):
    q, s, f = margin_tables(spark)
    grid = pricing.margin_grid(q, s, f)
    assert dicts(grid, "customer_ref_no", "part_no", "supplier", "qty", "price", "margin_percent", "final_total") == [
        {"customer_ref_no": "r", "part_no": "1", "supplier": "A", "qty": 2.0, "price": 100.0, "margin_percent": 15.0, "final_total": pytest.approx(230)},
        {"customer_ref_no": "r", "part_no": "1", "supplier": "A", "qty": 5.0, "price": 100.0, "margin_percent": 15.0, "final_total": pytest.approx(575)},
        {"customer_ref_no": "r", "part_no": "2", "supplier": None, "qty": 1.0, "price": 0.0, "margin_percent": 15.0, "final_total": 0.0},
    ]


def test_saved_twice_counts_once(spark):
    q, s, _ = margin_tables(spark)
    f = spark.createDataFrame([("SUB1", 10.0, 0), ("SUB1", 20.0, 1)], "selected_submission_id string, margin_percent double, _seq bigint")
    rows = dicts(pricing.margin_grid(q, s, f).where("part_no = '1'"), "margin_percent")
    assert rows == [{"margin_percent": 20.0}] * 2


def test_blank_edit_is_no_margin(spark):
    grid = pricing.margin_grid(*margin_tables(spark))
    edits = spark.createDataFrame([("q", "1", "SUB1", "30", "true", 0), ("q", "1", "SUB1", " ", "True", 1)], "quote_id string, part_no string, submission_id string, margin_percent string, select string, _seq bigint")
    edited = pricing.edited_grid(grid, edits)
    assert {r.margin_percent for r in edited.where("submission_id = 'SUB1'").collect()} == {0.0}
    assert {r.margin_percent for r in edited.where("submission_id IS NULL").collect()} == {15.0}
    assert pricing.margin_preview(edited).count() == 2


def test_save_replaces_every_quote_of_the_grid(spark):
    q, s, f = margin_tables(spark)
    typed = f.unionByName(f.limit(0))
    once = m.save_final(typed, pricing.margin_grid(q, s, f), DAY)
    twice = m.save_final(once, pricing.margin_grid(q, s, once), DAY)
    assert once.count() == 2 and dicts(once.drop(SEQ)) == dicts(twice.drop(SEQ))


def test_a_blocked_ref_is_not_exported(spark):
    q = quotes(spark, [{"quote_id": k, "customer_ref_no": k, "part_no": p} for k, p in [("a", "1"), ("a", "2"), ("b", "1")]])
    s = submissions(spark, [{"submission_id": "SUB1", "quote_id": "b", "part_no": "1"}])
    f = final_quotes(spark, [{"quote_id": "a", "part_no": "1", "selected_submission_id": "SUB9"}, {"quote_id": "a", "part_no": "2"},
                             {"quote_id": "b", "part_no": "1", "selected_submission_id": "SUB1"}])
    lines = pricing.exportable_lines(f, s, q)
    assert [r.customer_ref_no for r in pricing.export_blockers(lines).collect()] == ["a"]
    assert [r.ref_no for r in pricing.client_quote(lines).collect()] == ["b"]


def test_worker_queue(spark):
    a = assignments(spark, [{"quote_id": "q", "assigned_to": "1", "assigned_date": "2024-01-02", "worker_due_date": "x"},
                            {"quote_id": "q", "assigned_to": "1", "assigned_date": "", "worker_due_date": "y"},
                            {"quote_id": "gone", "assigned_to": "1", "assigned_date": "2024-01-02"}])
    q = quotes(spark, [{"quote_id": "q", "part_no": "1", "status": "ASSIGNED"}, {"quote_id": "q", "part_no": "2", "status": None}, {"quote_id": "gone", "part_no": "1", "status": "DELETED"}])
    s = submissions(spark, [{"quote_id": "q", "part_no": "1", "worker_id": "1", "no_quote": "YES"}, {"quote_id": "q", "part_no": "2", "worker_id": "2", "no_quote": "YES"}])
    assert dicts(worker.worker_queue(a, q, s), "worker_id", "quote_id", "part_no", "worker_due_date", "measure_unit") == [
        {"worker_id": "1", "quote_id": "gone", "part_no": None, "worker_due_date": None, "measure_unit": "EA"},
        {"worker_id": "1", "quote_id": "q", "part_no": "2", "worker_due_date": "y", "measure_unit": "EA"}]


def test_filters(spark):
    q = quotes(spark, [{"quote_id": "A.1", "status": "UPLOADED"}, {"quote_id": "ax1", "status": None}, {"quote_id": None, "status": "DELETED"}])
    assert filter_text(q, {"quote_id": "a.1"}).count() == 2
    assert filter_text(q, {"quote_id": "a.1"}, literal=True).count() == 1
    assert filter_text(q, {"quote_id": None, "absent": "x"}).count() == 3
    assert filter_in(q, {"status": []}).count() == 3
    assert non_deleted(q).count() == 2


def test_number_format(spark):
    assert spark.range(1).select(submission_id(F.lit(123456))).first()[0] == "SUB123456"
