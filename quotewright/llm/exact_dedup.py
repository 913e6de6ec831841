"""Exact duplicates by content sort.

Sampled splitters range-partition the rows by leading text and digest, each task sorts its range externally
so that equal texts lie next to each other, and every text is compared in full with its neighbour. The head
of a run is the row that stays.

A text with more copies than a task should hold is dealt to several slots first; the heads of its slots are
sorted and compared once more. There are at most ``4 * partitions`` such texts (each holds more than that
share of all rows), so the list of them is safe to broadcast at any size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Leading characters that range-partition the texts; with the digest behind them a sampled key stays short.
LEAD = 32
#: A task is meant to hold the rows of this many slots.
SLOTS_PER_TASK = 4


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical, without any normalisation; a null text counts as empty. Of equal texts the
    row with the largest id stays (the smallest with ``largest=False``). A null id stays only where all ids of
    the group are null. Of repeated rows with the same id exactly one is kept. An empty table gives an empty
    result. Other columns of ``docs``, whatever their names, are ignored.
    """
    return _compared(docs, id_col, text_col, largest, with_rows=False).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all columns of ``docs``; the rows travel with their text, once."""
    kept = _compared(docs, id_col, text_col, largest, with_rows=True).where("_kept")
    text = F.when(~F.col("_null"), F.col("_text"))
    return kept.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def _compared(docs: DataFrame, id_col: str, text_col: str, largest: bool, with_rows: bool) -> DataFrame:
    """Every row with the row that stays for it; ``with_rows`` keeps the text and other columns where needed."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in docs.columns if c != text_col] if with_rows else []
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.col(text_col).isNull().alias("_null"),
        F.struct(*[F.col(c) for c in others], F.lit(0).cast("byte").alias("_none")).alias("_row"),
    ).withColumns({"_sha": F.sha2("_text", 256), "_number": F.monotonically_increasing_id()})
    slot_rows = max(32, docs.count() // (SLOTS_PER_TASK * parts))
    hot = (
        rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > slot_rows)
        .select("_sha", F.ceil(F.col("_n") / slot_rows).cast("int").alias("_slots"))
    )
    dealt = (
        rows.join(F.broadcast(hot), "_sha", "left")  # at most SLOTS_PER_TASK * parts rows
        # by a number of each row: copies may share one id, or have none
        .withColumn("_slot", F.coalesce(F.pmod(F.xxhash64("_number"), F.col("_slots")), F.lit(0)).cast("int"))
        .withColumn("_lead", F.substring("_text", 1, LEAD))
        .drop("_number").repartitionByRange(parts, "_lead", "_sha", "_slot")
    )
    place = ["_lead", "_sha", "_slot"]
    by_id = F.desc_nulls_last("_id") if largest else F.asc_nulls_last("_id")
    best = F.max if largest else F.min
    neighbours = Window.partitionBy(*place).orderBy("_text", by_id)
    so_far = neighbours.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy(*place, "_run")
    # a text goes on only where it is compared again or, in the end, kept
    needed = F.col("_head") & (F.lit(with_rows) | F.col("_hot"))
    runs = (
        dealt.withColumn("_hot", F.col("_slots").isNotNull())
        .withColumn("_head", ~F.coalesce(F.lag("_text").over(neighbours) == F.col("_text"), F.lit(False)))
        .withColumn("_run", F.sum(F.col("_head").cast("int")).over(so_far))
        .withColumn("_text", F.when(needed, F.col("_text")))
        .withColumn("_best", best("_id").over(run))
        .withColumn("_n", F.count(F.lit(1)).over(run))
        .drop("_slots")
    )
    runs = materialize(runs, "content-runs")

    # heads of the slots of hot texts: at most 2 * SLOTS_PER_TASK * parts rows
    across = Window.partitionBy("_sha").orderBy("_text")
    equal = Window.partitionBy("_sha", "_group")
    merged = (
        runs.where(F.col("_hot") & F.col("_head"))
        .withColumn("_new", ~F.coalesce(F.lag("_text").over(across) == F.col("_text"), F.lit(False)))
        .withColumn("_group", F.sum(F.col("_new").cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "_sha", "_slot", "_run",
            best("_best").over(equal).alias("_all_best"), F.sum("_n").over(equal).alias("_all_n"),
            # slots may share their best id: one of them keeps it
            (F.row_number().over(equal.orderBy(by_id, "_slot", "_run")) == 1).alias("_chosen"),
        )
    )
    whole = runs.join(F.broadcast(merged), ["_sha", "_slot", "_run"], "left")
    keep = F.when(F.col("_all_n").isNull(), F.col("_best")).otherwise(F.col("_all_best"))
    return whole.withColumns({
        "_keep": keep, "_size": F.coalesce("_all_n", "_n"), "_kept": F.col("_head") & F.coalesce("_chosen", F.lit(True))})
