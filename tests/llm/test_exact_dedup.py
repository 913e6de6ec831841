import hashlib
from collections import defaultdict

import pytest
from frames import docs, edge_rows

from quotewright.llm import exact_dedup as exact
from quotewright.llm.exact_dedup import drop_copies, exact_dedup
from quotewright.session import materialize


def brute(rows, best=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        kept_at = ids.index(keep)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), place == kept_at, sha) for place, i in enumerate(ids)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("largest", [True, False])
def test_edges(spark, largest):
    rows = edge_rows()
    got = rows_of(exact_dedup(docs(spark, rows), largest=largest))
    assert got == brute(rows, max if largest else min)


def test_hot_text_is_dealt_to_slots(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 150}") for i in range(300)] + [(5000, "hott")]
    assert rows_of(exact_dedup(docs(spark, rows))) == brute(rows)


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: 7 if i % 2 else None])
def test_hot_text_of_one_id_is_dealt_to_slots(spark, ids):
    rows = [(ids(i), "hot") for i in range(3000)] + [(1000 + i, f"t{i % 150}") for i in range(300)]
    found = exact_dedup(docs(spark, rows))
    assert rows_of(found) == brute(rows)
    # the runs that were compared in one task hold no more than a share of the copies
    (path,) = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    runs = spark.read.parquet(path)
    assert max(r["count"] for r in runs.groupBy("_sha", "_slot").count().collect()) < 1000


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_keeps_whole_rows(spark):
    rows = edge_rows()
    df = docs(spark, rows)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    # of a null and an empty text the largest id stays, with its own text
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert (2, "") in got and (1, None) not in got and (7, rows[8][1]) in got and (5, "one") in got
    assert kept.count() == len({t or "" for _, t in rows})


def test_plan_has_no_python(spark):
    plan = exact_dedup(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_written_steps_have_no_python(spark, monkeypatch):
    """The plans of all tables written on the way, not only of the last one."""
    plans = []
    monkeypatch.setattr(exact, "materialize", lambda df, label: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or materialize(df, label))
    exact_dedup(docs(spark, [(1, "a")])).count()
    assert plans and not any(x in plan for plan in plans for x in ("Python", "Arrow", "Cartesian"))
