"""Table sources and sinks: tolerant CSV at the edge, Parquet inside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import date_text, null_if_token, to_date
from ..operators.joins import lookup
from ..operators.numbering import with_position
from ..schemas import SEQ, column_name
from ..session import materialize
from .records import read_records

_SURPLUS = "_surplus"
_NO_DATA = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Heading row of a CSV table; empty when there is no such file or nothing in it."""
    try:
        return spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() in _NO_DATA:
            return []
        raise


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True,
    number_rows: bool = False,
) -> DataFrame:
    """CSV table in the layout of ``schema``, as text, tolerant of broken rows.

    A row with too many fields is skipped, a short row is padded with nulls; a missing or empty file
    gives an empty table. Columns are matched by heading, missing ones are null, others dropped.

    ``multiline`` keeps quoted line breaks together but reads each file in one piece: turn it off for
    large files without line breaks in fields, so that they are split. ``number_rows`` fills ``_seq``
    from (file time, file path, place in file) and writes the result out once.
    """
    headings = _csv_columns(spark, path)
    if not headings:
        return empty_table(spark, schema)
    layout = T.StructType([T.StructField(h, T.StringType()) for h in [*headings, _SURPLUS]])
    raw = (
        spark.read.schema(layout)
        .options(header=True, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE")
        .csv(path)
    )
    source = "_metadata.file_"
    rows = raw.where(F.col(_SURPLUS).isNull())
    columns = [F.col(f"`{h}`").alias(column_name(h)) for h in headings]
    if not number_rows:
        return enforce_schema(null_tokens(rows.select(columns)), schema)
    place = [
        F.col(source + "modification_time").alias("_time"),
        F.col(source + "path").alias("_path"),
        F.col(source + "block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]
    # The place is fixed on disk before it is used to sort: it depends on how the scan was split.
    placed = materialize(rows.select(*columns, *place), "landing")
    numbered = with_position(
        null_tokens(placed.drop(SEQ)), ["_time", "_path", "_block", "_row"], SEQ
    )
    return enforce_schema(numbered, schema)


def read_split_table(spark: SparkSession, path: str, schema: T.StructType, number_rows: bool = False) -> DataFrame:
    """``read_table`` for files of any size with line breaks inside fields, split by byte ranges (``sources.records``).

    A row with a field too many is skipped, also if that field is empty; a short row is padded with nulls. Files have
    a heading row each, all the same. ``number_rows`` fills ``_seq`` from the place of the record.
    """
    headings = _csv_columns(spark, path)
    if not headings:
        return empty_table(spark, schema)
    records = read_records(spark, path)
    # the first record of a file is its heading row
    heads = records.where("range = 0").groupBy("file").agg(F.min("line").alias("line")).withColumn("range", F.lit(0).cast("bigint"))
    rows = lookup(records, heads.withColumn("_head", F.lit(True)), ["file", "range", "line"])
    rows = rows.where(F.col("_head").isNull() & (F.col("fields") <= len(headings)))
    layout = ", ".join(f"`{h}` string" for h in headings)
    parsed = rows.withColumn("_fields", F.from_csv("record", layout, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}))
    columns = [F.col("_fields").getField(h).alias(column_name(h)) for h in headings]
    if not number_rows:
        return enforce_schema(null_tokens(parsed.select(columns)), schema)
    columns = [c for c, h in zip(columns, headings) if column_name(h) != SEQ]
    placed = null_tokens(parsed.select(*columns, F.col("file").alias("_file"), F.col("range").alias("_block"), F.col("line").alias("_number")))
    return enforce_schema(with_position(placed, ["_file", "_block", "_number"], SEQ), schema)


def null_tokens(df: DataFrame) -> DataFrame:
    """Text that stands for a missing value becomes null, in every text column."""
    return df.select(
        [
            null_if_token(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "DATE" in c.upper()]


def normalize_dates(df: DataFrame, cols: list[str] | None = None, few: DataFrame | None = None) -> DataFrame:
    """Rewrite date columns as ``yyyy-MM-dd`` text, unreadable values as the empty text.

    A column in which no value at all reads as a date is left as it is. Whether one does is a scalar subquery
    per column, run only where the column is used: each task reads up to its first date, and the table itself is not
    shuffled. ``few``, for a table that is costly to read, are some of its rows: the table is only looked at for a column
    of which they have no date.
    """
    cols = date_columns(df) if cols is None else cols

    def any_of(rows: DataFrame, dated: Column) -> Column:
        return rows.where(dated).select(F.lit(True).alias("seen")).limit(1).scalar()

    def seen(c: str) -> Column:
        dated = to_date(df[c]).isNotNull()
        if few is None:
            return any_of(df, dated)
        first = any_of(few, to_date(few[c]).isNotNull())
        return F.coalesce(first, any_of(df, F.when(first.isNull(), dated)))

    return df.withColumns({c: F.when(seen(c), date_text(F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c in cols})


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order: missing ones null, extra ones dropped."""
    present = set(df.columns)
    return df.select(
        [
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Trim the headings, insist on the required ones, and keep only those, in order."""
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in required if c not in trimmed.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return trimmed.select([F.col(f"`{c}`") for c in required])


def rename_headings(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(headings)


def append_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` followed by ``new`` in the layout of ``base``."""
    return base.unionByName(enforce_schema(new, base.schema))


def write_table(df: DataFrame, path: str) -> str:
    """Write a new version of a table; a path in use is refused, versions are never overwritten."""
    df.write.mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, headings: dict[str, str] | None = None) -> str:
    """CSV with every field quoted; ``headings`` maps column names back to the file headings."""
    out = df.withColumnsRenamed(headings or {})
    out.write.options(header=True, quoteAll=True, quote='"', escape='"').csv(path)
    return path


def import_replace(
    spark: SparkSession, source: str, schema: T.StructType, target: str, **options: bool
) -> DataFrame:
    """Read an uploaded CSV in the layout of ``schema`` and make it the new version of the table."""
    table = read_table(spark, source, schema, **options)
    return spark.read.schema(schema).parquet(write_table(table, target))


def export_view(
    df: DataFrame, path: str, fmt: str = "csv", by: str | None = None, within: list[str] | None = None
) -> int:
    """Write a view for people and return its row count; 0 means that there was nothing to export.

    With ``by`` all customers are exported in one job, one folder each. Rows are placed by range of
    (``by``, ``within``): folders get few files, and a customer with very many rows is still written
    by several tasks.
    """
    rows = Observation()
    if by:
        df = df.repartitionByRange(by, *(within or []))
    # counted after the shuffle: placing rows by range reads them once more to take samples
    counted = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.options(header=True, quoteAll=True, escape='"') if fmt == "csv" else counted.write
    if by:
        writer = writer.partitionBy(by)
    writer.format(fmt).save(path)
    return rows.get["rows"]
