"""Cleaning a whole bundle, picking one worker or ref, and where scratch tables go."""

import pytest
from helpers import assignments, bundle, dicts, quotes, submissions, users
from quotewright import session
from quotewright.bundle import Tables
from quotewright.operators.clean import clean_tables
from quotewright.operators.filters import for_ref, for_worker
from quotewright.sources import testdata
from helpers import final_quotes


def test_clean_tables(spark):
    raw = Tables(
        quotes=quotes(spark, [{"quote_id": " q ", "part_no": "p\t", "status": " deleted", "date": "2024-1-2", "qty": "n/a"}]),
        submissions=submissions(spark, [{"submission_id": " SUB1", "supplier": " NaN ", "edit_required": "yes ", "no_quote": None, "submitted_date": "x"}]),
        assignments=assignments(spark, [{"quote_id": "q", "assigned_to": " 1", "assigned_date": "bad"}, {"quote_id": "q", "assigned_date": "2024-01-02"}]),
        users=users(spark, [{"user_id": " 1 ", "username": "ann", "role": "worker"}]),
        final_quotes=final_quotes(spark, [{"quote_id": "q", "supplier": None, "selected_submission_id": "nan"}]),
    )
    t = clean_tables(raw)
    assert dicts(t.quotes, "quote_id", "part_no", "status", "date", "qty") == [
        {"quote_id": "q", "part_no": "p", "status": "DELETED", "date": "2024-01-02", "qty": None}]
    # no value of the column reads as a date, so it stays as it is
    assert dicts(t.submissions, "submission_id", "supplier", "edit_required", "no_quote", "submitted_date") == [
        {"submission_id": "SUB1", "supplier": "", "edit_required": "YES", "no_quote": "NO", "submitted_date": "x"}]
    assert {r.assigned_date for r in t.assignments.collect()} == {"", "2024-01-02"}
    assert t.users.first().user_id == "1"
    assert dicts(t.final_quotes, "supplier", "selected_submission_id") == [{"supplier": "", "selected_submission_id": None}]


def test_one_worker_one_ref(spark):
    t = bundle(spark, q=[{"customer_ref_no": "r"}, {"customer_ref_no": "s"}], s=[{"worker_id": "1"}, {"worker_id": "2"}])
    assert for_ref(t.quotes, " r ").count() == 1
    assert for_worker(t.submissions, "2").count() == 1


class FakeSession:
    def __init__(self, folder, master):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder():
    assert session.shared_dir(FakeSession("hdfs://x/ckpt/", "yarn")) == "hdfs://x/ckpt"
    assert session.shared_dir(FakeSession(None, "local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession(None, "spark://host:7077"))


def test_lines_are_joined_once_for_all_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name in ("quotes", "submissions", "final_quotes"):
        testdata.clean_table(spark, sf_dir, name)
        raw = testdata.raw_table(spark, sf_dir, name)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        assert "/lines-" in plan and "Join" not in plan and "Exchange" not in plan
    stored = [label for app, folder, label in testdata._built if app == spark.sparkContext.applicationId and folder == sf_dir]
    assert stored.count("lines") == 1 and not [label for label in stored if label.startswith("raw-")]
