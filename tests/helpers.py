"""Small frames for tests."""

from __future__ import annotations

from quotewright.bundle import Tables
from quotewright.schemas import ASSIGNMENTS, FINAL_QUOTES, QUOTES, SEQ, SUBMISSIONS, USERS


def frame(spark, schema, rows, **defaults):
    """Rows as dicts; absent columns take a default or null; ``_seq`` counts up unless given."""
    full = [
        tuple({**defaults, SEQ: i, **row}.get(name) for name in schema.names) for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def quotes(spark, rows, **defaults):
    return frame(spark, QUOTES, rows, **defaults)


def submissions(spark, rows, **defaults):
    base = {"supplier": "", "edit_required": "NO", "no_quote": "NO", "worker_id": "1"}
    return frame(spark, SUBMISSIONS, rows, **{**base, **defaults})


def assignments(spark, rows, **defaults):
    return frame(spark, ASSIGNMENTS, rows, part_no="ALL", **defaults)


def users(spark, rows):
    return frame(spark, USERS, rows)


def final_quotes(spark, rows, **defaults):
    return frame(spark, FINAL_QUOTES, rows, **defaults)


def bundle(spark, q=(), s=(), a=(), u=(), f=()):
    return Tables(quotes(spark, q), submissions(spark, s), assignments(spark, a), users(spark, u), final_quotes(spark, f))


def dicts(df, *cols):
    rows = [r.asDict() for r in (df.select(*cols) if cols else df).collect()]
    return sorted(rows, key=lambda r: [(v is not None, str(v)) for v in r.values()])


def column(df, fn, values, schema="v string"):
    """Apply a column function to a list of values, results in the same order."""
    from pyspark.sql import functions as F

    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    data = df.createDataFrame(rows, "i int, " + schema)
    names = data.columns[1:]
    return [r[0] for r in data.orderBy("i").select(fn(*[F.col(n) for n in names])).collect()]
