"""One row per key: first, last, latest.

These are ``min_by`` / ``max_by`` aggregates, not windows: each task keeps one row per key before the
shuffle, so a key with a third of all rows costs one row per task and no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import to_date
from ..schemas import SEQ


def _pick(df: DataFrame, keys: list[str], picker, order: Column | str, extra: dict[str, Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        picker(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("_row"),
        *[c.alias(name) for name, c in extra.items()],
    )
    columns = [k if k in keys else F.col(f"_row.`{k}`").alias(k) for k in df.columns]
    return picked.select(*columns, *extra)


def first_per(df: DataFrame, keys: list[str], order: Column | str = SEQ, **extra: Column) -> DataFrame:
    """First row of each group; ``extra`` adds aggregates of the group."""
    return _pick(df, keys, F.min_by, order, extra)


def last_per(df: DataFrame, keys: list[str], order: Column | str = SEQ, **extra: Column) -> DataFrame:
    """Last row of each group; ``extra`` adds aggregates of the group."""
    return _pick(df, keys, F.max_by, order, extra)


def last_assignment(assignments: DataFrame) -> DataFrame:
    """Last assignment of each quote in file order."""
    return last_per(assignments.where(F.col("quote_id").isNotNull()), ["quote_id"])


def latest_assignment(assignments: DataFrame) -> DataFrame:
    """Latest assignment per worker and quote by date; one without a readable date counts as latest."""
    day = to_date(F.col("assigned_date"))
    known = assignments.where(F.col("quote_id").isNotNull() & F.col("assigned_to").isNotNull())
    return last_per(known, ["assigned_to", "quote_id"], F.struct(day.isNull(), day, F.col(SEQ)))


def latest_quote_meta(quotes: DataFrame) -> DataFrame:
    """Reference, description and status of the latest line per (quote, part) by date text.

    Here a line without a date loses: its date text is empty and sorts lowest.
    """
    known = quotes.where(F.col("quote_id").isNotNull() & F.col("part_no").isNotNull())
    meta = ["customer_ref_no", "description", "status"]
    # date and place only order the rows: within the row kept they would be shuffled a second time
    latest = F.max_by(F.struct(*meta), F.struct(F.coalesce("date", F.lit("")), F.col(SEQ))).alias("_row")
    return known.groupBy("quote_id", "part_no").agg(latest).select("quote_id", "part_no", *[f"_row.{c}" for c in meta])


def first_status(quotes: DataFrame, key: str) -> DataFrame:
    """Status and quote id of the first line of each group (a customer ref or a quote)."""
    first = F.min_by(F.struct("status", "quote_id"), SEQ)
    grouped = quotes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_group"))
    return grouped.agg(first.alias("_first")).select(
        F.col("_group").alias(key),
        F.col("_first.status").alias("first_status"),
        F.col("_first.quote_id").alias("first_quote_id"),
    )
