"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on: a hot join key is split at run time, also where that costs one more shuffle
# further on; small sides turn into broadcasts by measured size. ``maxShuffledHashJoin...`` lets a join skip its
# sorts where every partition of a side is this small. ``zstd`` stored the clean tables in about a
# quarter less space than the default. Tasks of 16 MB of compressed shuffle hold rows that they sort in memory.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.parquet.compression.codec": "zstd",
}

_local_dir: tempfile.TemporaryDirectory | None = None


def local_session(cores: str = "*", app: str = "quotewright", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in {**RECOMMENDED_CONF, **settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Parquet bytes of the widest table for which a shuffle starts with one partition: some 300,000 order lines, which a
# task joins or sorts without spilling. Adaptive execution puts partitions that turn out small together again.
BYTES_PER_PARTITION = 4 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the settings to a running session; all of them can be changed at run time.

    ``input_bytes`` raises the number of partitions a shuffle starts with, where the session has too few for it.
    """
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // BYTES_PER_PARTITION))
    spark.conf.set(_INITIAL, str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may fall back to a temporary folder; it is removed at exit.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.TemporaryDirectory(prefix="quotewright-")
    return _local_dir.name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, below one folder per application."""
    run = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/quotewright-{run}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, and values that depend on how the rows were
    partitioned are fixed for every later use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
