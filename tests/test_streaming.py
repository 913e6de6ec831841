import pytest
from helpers import bundle, dicts, frame
from quotewright.plans.mutations import submit_offers
from quotewright.plans.versioned import Desk
from quotewright.schemas import OFFER_REQUESTS, SEQ
from quotewright.session import scratch_path
from quotewright.streaming import intake


def offers(spark, rows):
    return frame(spark, OFFER_REQUESTS, [{"worker_id": "w", "price": "1", **r} for r in rows])


def test_batches_in_sequence_and_replay(spark):
    landing, log, progress = (scratch_path(spark, n) for n in ("landing", "log", "progress"))
    t = bundle(spark, q=[{"quote_id": "q", "part_no": p, "status": "ASSIGNED"} for p in "12"])
    first = offers(spark, [{"quote_id": "q", "part_no": "1", "supplier": "A"}, {"quote_id": "q", "part_no": "1", "supplier": " "}])
    second = offers(spark, [{"quote_id": "q", "part_no": "2", "supplier": "B"}, {"quote_id": "q", "part_no": "1", "supplier": "A", "price": "8"}])
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(landing)
        intake.stream_offers(spark, landing, log, progress).awaitTermination()
    got = intake.current_offers(t, log, "2024-06-30")
    step = submit_offers(submit_offers(t, first, "2024-06-30"), second, "2024-06-30")
    assert dicts(got.submissions.drop(SEQ)) == dicts(step.submissions.drop(SEQ))
    assert [r.status for r in got.quotes.collect()] == ["SUBMITTED", "SUBMITTED"]

    # a batch written again lands in its own folder
    before = dicts(intake.read_log(spark, log, OFFER_REQUESTS))
    replayed = spark.read.schema(OFFER_REQUESTS).parquet(f"{log}/batch_id=1")
    replayed = spark.createDataFrame(replayed.collect(), OFFER_REQUESTS)
    replayed.write.mode("overwrite").parquet(f"{log}/batch_id=1")
    assert dicts(intake.read_log(spark, log, OFFER_REQUESTS)) == before


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_compaction_applies_each_batch_once(spark, fmt, monkeypatch):
    landing, log, progress, root = (scratch_path(spark, n) for n in ("landing", "log", "progress", "desk"))
    t = bundle(spark, q=[{"quote_id": "q", "part_no": p, "status": "ASSIGNED"} for p in "123"])
    desk = Desk(spark, root)
    desk.create(t)
    step, day = t, "2024-06-30"
    batches = [
        [{"quote_id": "q", "part_no": "1", "supplier": "A"}, {"quote_id": "q", "part_no": "2", "supplier": "nan", "remarks": "no supplier"}],
        [{"quote_id": "q", "part_no": "2", "supplier": "B", "remarks": 'two "quoted"\nlines'}],
        [{"quote_id": "q", "part_no": "1", "supplier": "A", "price": "8"}, {"quote_id": "q", "part_no": "3", "supplier": "C"}],
    ]

    def land(rows):
        made = offers(spark, [{"certificate_available": "NO", **r} for r in rows])
        writer = made.coalesce(1).write.mode("append")
        writer.options(header=True, quoteAll=True, escape='"').csv(landing) if fmt == "csv" else writer.parquet(landing)
        intake.stream_offers(spark, landing, log, progress, fmt=fmt).awaitTermination()
        return made

    read = []
    monkeypatch.setattr(intake, "read_log", lambda *args, f=intake.read_log: read.append(args[3]) or f(*args))
    for n, rows in enumerate(batches):
        step = submit_offers(step, land(rows), day)
        if n == 0:
            # a run that stops before its version is published has done nothing
            with monkeypatch.context() as broken:
                broken.setattr(desk.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    intake.compact_offers(desk, log, day)
            assert desk.latest().number == 0 and desk.tables().submissions.count() == 0
        outcome = intake.compact_offers(desk, log, day)
        assert outcome.snapshot.notes == {"offers_applied": n}
        assert intake.compact_offers(desk, log, day) is None  # nothing new
        # a batch that is written again changes nothing
        spark.createDataFrame([], OFFER_REQUESTS).write.mode("overwrite").parquet(f"{log}/batch_id={n}")
        assert intake.compact_offers(desk, log, day) is None
        got = desk.tables()
        assert dicts(got.submissions.drop(SEQ)) == dicts(step.submissions.drop(SEQ))
        assert dicts(got.quotes) == dicts(step.quotes)
    assert read == [[0], [0], [1], [2]]  # each compaction reads its own batches
    assert {r.status for r in desk.tables().quotes.collect()} == {"SUBMITTED"}


def test_batches_that_are_not_whole_wait(spark):
    log = scratch_path(spark, "log")
    assert intake.complete_batches(spark, log) == []
    for n in (0, 1, 2, 10):
        offers(spark, []).write.parquet(f"{log}/batch_id={n}")
    assert intake.complete_batches(spark, log) == [0, 1, 2, 10]
    assert intake.complete_batches(spark, log, 1) == [2, 10]
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{log}/batch_id=1/_SUCCESS")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
    assert intake.complete_batches(spark, log) == [0]
