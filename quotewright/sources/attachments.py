"""The attachment store: a folder of files, listed without reading their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name


def stored_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listing.select(base_name(F.col("path")).alias("file_name"), F.col("length").alias("bytes"))
