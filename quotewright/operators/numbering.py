"""Consecutive numbers for rows of any number, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import submission_id, submission_number, to_number
from ..schemas import SEQ
from ..session import materialize
from .joins import fresh_keys

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below this bit


def with_position(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """Add the 0-based place of each row in the total order ``order``.

    Rows are range-partitioned and written out once, which fixes (partition, place in partition).
    The places become global by adding the sizes of the earlier partitions: one number per partition,
    so the only single-task window runs over as many rows as there are partitions.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "ordered").withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        # one row per partition of the file just written, whatever the table size
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + place)
        .drop("_row", "_part", "_offset")
    )


def with_group_position(df: DataFrame, keys: list[str], order: list[str], name: str = "_pos") -> DataFrame:
    """0-based place of each row within its key group; a group may span any number of tasks."""
    placed = with_position(df, [*keys, *order], "_global")
    first = placed.groupBy(*keys).agg(F.min("_global").alias("_first"))
    first = fresh_keys(first, keys).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    joined = placed.join(first, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return joined.withColumn(name, F.col("_global") - F.col("_first")).select(*df.columns, name)


def highest_submission_number(submissions: DataFrame) -> Column:
    """Largest number among ``SUB…`` ids, 0 when there is none, as a scalar subquery."""
    top = F.coalesce(F.max(submission_number(F.col("submission_id"))), F.lit(0))
    return submissions.agg(top.cast("bigint")).scalar()


def highest_seq(df: DataFrame) -> Column:
    return df.agg(F.coalesce(F.max(SEQ), F.lit(-1)).cast("bigint")).scalar()


def next_submission_id(submissions: DataFrame) -> DataFrame:
    """One row: the next free number and id."""
    top = F.coalesce(F.max(submission_number(F.col("submission_id"))), F.lit(0)).cast("bigint")
    return submissions.agg((top + 1).alias("next_number")).withColumn(
        "next_id", submission_id(F.col("next_number"))
    )


def next_numeric_id(df: DataFrame, col: str) -> DataFrame:
    """One row: largest numeric value of a text id column + 1, or 1."""
    top = F.coalesce(F.max(to_number(F.col(col), "decimal(38,0)")), F.lit(0))
    return df.agg((top + 1).cast("bigint").alias("next_number"))


def assign_submission_ids(batch: DataFrame, submissions: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive new submission ids for a batch, in the given order; adds ``submission_id``."""
    placed = with_position(batch, order, "_pos")
    number = highest_submission_number(submissions) + F.lit(1) + F.col("_pos")
    return placed.withColumn("submission_id", submission_id(number)).drop("_pos")
