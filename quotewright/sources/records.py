"""CSV with line breaks inside quoted fields, read by many tasks.

Spark's own reader takes such a file in one piece. Here files are split into byte ranges like any text, and the lines
of each range are counted: how many quotes they hold. A line starts inside a quoted field if the number of quotes
before it in its file is odd. That number is a sum over ranges, one row for each, and a running sum inside a range.
Records are cut where a line starts outside of quotes; those of one line, nearly all, are done at once, and the lines
of the others are put together, one record each.

Quotes are read as they are written by ``write_csv`` and most programs: a field with a quote, separator or line break
is quoted as a whole, and a quote inside it is doubled. A single quote inside a field that is not quoted opens one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import materialize

_RANGE = ["_file_part", "_range_part"]  # a file, and where the byte range starts in it


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in place: file, byte range, and a number that grows inside a range; written, as it depends on the scan."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file_part"), F.col("_metadata.file_block_start").alias("_range_part"),
        F.monotonically_increasing_id().alias("_line"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return materialize(read.withColumn("_odd", (quotes % 2).cast("int")), "csv-lines")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, file, range, line, fields``: the records of CSV files, heading rows included, in place.

    ``line`` numbers the first line of a record inside its byte ``range``; ``fields`` is how many fields it has. Line
    ends are cut off; a carriage return before one counts as part of it, inside fields too. Empty lines are no records.
    """
    lines = _lines(spark, path)
    # a range is one task's share of a file; its lines are numbered and summed there
    inside = Window.partitionBy(*_RANGE).orderBy("_line")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy(*_RANGE).agg((F.sum("_odd") % 2).alias("_total"))
    earlier = Window.partitionBy("_file_part").orderBy("_range_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.select(*_RANGE, (F.coalesce(F.sum("_total").over(earlier), F.lit(0)) % 2).alias("_open")), "csv-ranges")
    placed = lookup(lines, ranges, _RANGE)
    starts_open = (F.col("_open") + F.coalesce(F.sum("_odd").over(before), F.lit(0))) % 2
    placed = placed.withColumn("_starts_open", starts_open == 1).withColumn(
        "_ends_open", (F.col("_starts_open").cast("int") + F.col("_odd")) % 2 == 1)
    first = F.when(~F.col("_starts_open"), F.col("_line"))
    placed = placed.withColumn("_first", F.max(first).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialize(placed, "csv-places")

    whole = placed.where(~F.col("_starts_open") & ~F.col("_ends_open")).select(
        F.col("value").alias("record"), *_RANGE, F.col("_first").alias("_line"))
    several = placed.where(F.col("_starts_open") | F.col("_ends_open"))
    # a record that began in an earlier range: the last one that this file had there
    last = placed.groupBy(*_RANGE).agg(F.max("_first").alias("_last"))
    carried = last.withColumn("_from", F.last(F.when(
        F.col("_last").isNotNull(), F.struct(F.col("_range_part").alias("range"), F.col("_last").alias("line"))), ignorenulls=True).over(earlier))
    own = F.struct(F.col("_range_part").alias("range"), F.col("_first").alias("line"))
    start = F.when(F.col("_first").isNotNull(), own).otherwise(F.col("_from"))
    joined = lookup(several, materialize(carried.select(*_RANGE, "_from"), "csv-ranges"), _RANGE).withColumn("_start", start)
    # the lines of one record, which is one row
    put = joined.groupBy("_file_part", "_start").agg(F.array_sort(F.collect_list(F.struct("_range_part", "_line", "value"))).alias("_all"))
    put = materialize(put.select(
        F.array_join(F.transform("_all", lambda x: x["value"]), "\n").alias("record"), "_file_part",
        F.col("_start.range").alias("_range_part"), F.col("_start.line").alias("_line")), "csv-records")
    records = whole.unionByName(put).withColumn("record", F.regexp_replace("record", "\r(\n|$)", "$1"))
    return records.where(F.col("record") != "").select(
        "record", F.col("_file_part").alias("file"), F.col("_range_part").alias("range"), F.col("_line").alias("line"),
        field_count(F.col("record")).alias("fields"))


def field_count(record: Column) -> Column:
    """How many fields a record has: separators outside of quotes, and one."""
    outside = F.regexp_replace(record, '"[^"]*+"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1
