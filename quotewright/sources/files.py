"""Small text files in the store that Spark reads and writes: listed, read, and published once."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

_publishing = threading.Lock()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist. Names that start with a dot are left out."""
    _, system, place = _file_system(spark, folder)
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(name for name in names if not name.startswith("."))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder; 0 if there is none."""
    _, system, place = _file_system(spark, path)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def read_text(spark: SparkSession, path: str) -> str:
    jvm, system, place = _file_system(spark, path)
    stream = system.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is there whole or not at all; ``FileExistsError`` if there is one of that name.

    The text goes to a hidden file first, and a rename that refuses to replace makes it visible. That is one atomic
    step where the store's rename is one (HDFS); on a local disk it is for the threads of one driver.
    """
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    jvm, system, place = _file_system(spark, hidden)
    stream = system.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    with _publishing:
        if system.exists(target):
            system.delete(place, False)
            raise FileExistsError(path)
        try:
            context.rename(system.makeQualified(place), system.makeQualified(target), no_options)
        except Exception as e:
            if system.exists(target):  # another driver was faster
                system.delete(place, False)
                raise FileExistsError(path) from e
            raise
