"""Aggregates over quotes and submissions. All combine inside each task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import to_number
from ..schemas import COMPLETED, DELETED, UPLOADED
from .filters import supplier_offers
from .joins import pair


def pending_quotes(quotes: DataFrame, number_type: str = "double") -> DataFrame:
    """Uploaded quotes waiting for a worker: part lines with a part number, total quantity."""
    waiting = quotes.where((F.col("status") == UPLOADED) & F.col("quote_id").isNotNull())
    return waiting.groupBy("quote_id").agg(
        F.count("part_no").alias("part_count"),
        F.sum(to_number(F.col("qty"), number_type, 0)).alias("total_qty"),
    )


def requested_parts(quotes: DataFrame) -> DataFrame:
    """Per quote: distinct parts asked for, and whether a line bars a change of status."""
    known = quotes.where(F.col("quote_id").isNotNull())
    barred = F.coalesce(F.col("status").isin(DELETED, COMPLETED), F.lit(False))
    return known.groupBy("quote_id").agg(
        F.count_distinct("part_no").alias("requested"), F.bool_or(barred).alias("closed")
    )


def answered_parts(submissions: DataFrame, include_no_quote: bool = True) -> DataFrame:
    """Per quote: distinct parts with a submission, or only with an offer from a named supplier."""
    rows = submissions if include_no_quote else supplier_offers(submissions)
    known = rows.where(F.col("quote_id").isNotNull())
    return known.groupBy("quote_id").agg(F.count_distinct("part_no").alias("answered"))


def quote_progress(quotes: DataFrame, submissions: DataFrame) -> DataFrame:
    """Requested and answered parts per quote, counting no-quotes (``answered``) and not
    (``answered_by_supplier``)."""
    by_supplier = answered_parts(submissions, False).withColumnRenamed("answered", "answered_by_supplier")
    joined = pair(
        pair(requested_parts(quotes), answered_parts(submissions), ["quote_id"]), by_supplier, ["quote_id"]
    )
    return joined.fillna(0, ["answered", "answered_by_supplier"])


def fully_submitted(quotes: DataFrame, submissions: DataFrame) -> DataFrame:
    """Quotes with every requested part answered and no deleted or completed line."""
    joined = pair(requested_parts(quotes), answered_parts(submissions), ["quote_id"])
    complete = (F.col("requested") > 0) & (F.col("answered") >= F.col("requested")) & ~F.col("closed")
    return joined.where(complete).select("quote_id", "requested", "answered")


def distinct_options(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values to choose from, per column, nulls left out: one scan and one shuffle for all columns."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.value")
        .where(F.col("value").isNotNull()).distinct()
    )


def option_list(df: DataFrame, col: str, group: str) -> DataFrame:
    """Sorted list of the values of ``col`` per group; for columns with a small domain."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(col)).alias("options"))


def sole_value(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """The value of ``col`` per group if there is only one, else null."""
    only: Column = F.when(F.min(col) == F.max(col), F.min(col))
    return df.groupBy(*keys).agg(only.alias(name))
