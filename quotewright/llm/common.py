"""What the operators share: the session settings they rely on and how their code reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import tune

# Rows and bytes of one Arrow batch: a batch holds a few long documents or some hundred short ones.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for a session that runs operators, and the package itself on every executor."""
    tune(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks import it there.

    Only the small archive of source files leaves the driver; Spark's own file server delivers it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    folder_of_archive = tempfile.TemporaryDirectory(prefix="quotewright-")  # until the driver ends
    archive = os.path.join(folder_of_archive.name, "quotewright_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
    context.addPyFile(archive)
    _shipped[context.applicationId] = folder_of_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def draw_sample(rows: DataFrame, per_class: int, chars: int) -> list[Row]:
    """``text, label`` of at most ``per_class`` rows of each label: those with the least hash of id and text.

    ``rows`` has ``doc_id, text, label``, none of text and label null. Repeated rows count once, so that a row with
    very many copies neither fills the sample nor pushes others out. Of a text longer than ``chars`` a piece of that
    length is taken, from a place that its hash picks. The same rows give the same sample in the same order; what
    reaches the driver is bounded by the two numbers and the labels there are.
    """
    hashed = rows.select("text", "label", F.xxhash64("doc_id", "text").alias("_hash"))
    found = hashed.groupBy("label").agg(F.approx_count_distinct("_hash").alias("_different"))
    # a few times as many as needed are ranked, each label's by itself
    share = F.lit(4.0 * per_class * (1 << 32)) / F.col("_different")
    few = hashed.select("label", "_hash").join(F.broadcast(found), "label").where(F.pmod("_hash", F.lit(1 << 32)) < share)
    least = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("_hash", F.lit(1 << 32)), "_hash"))
    picked = few.select("label", "_hash").distinct().withColumn("_rank", least).where(F.col("_rank") <= per_class).drop("_rank")
    start = F.pmod(F.xxhash64("_hash"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    piece = F.when(F.length("text") > chars, F.substring("text", start.cast("int"), F.lit(chars))).otherwise(F.col("text"))
    # as many rows as were picked
    sample = hashed.join(F.broadcast(picked), ["label", "_hash"]).dropDuplicates(["label", "_hash"])
    return sorted(sample.select("_hash", piece.alias("text"), "label").collect())
