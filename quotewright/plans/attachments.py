"""Certificate files: which ones go along with a quote, are missing, or can be removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import base_name, clean_text, has_text
from ..operators.filters import non_deleted
from ..operators.joins import drop_keys, keep_keys
from ..operators.latest import first_per
from ..schemas import SEQ


def _named_files(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("file_name", clean_text(F.col("certificate_file"))).where("file_name <> ''")


def attachment_manifest(final_quotes: DataFrame, submissions: DataFrame, quotes: DataFrame, files: DataFrame) -> DataFrame:
    """Per customer ref the stored files of its final rows, each once.

    The file of a final row is that of the first submission with the chosen id, blank if that one
    names none.
    """
    chosen = final_quotes.where(has_text(F.col("selected_submission_id"))).select(
        "quote_id", F.col("selected_submission_id").alias("submission_id")
    ).distinct()
    first = first_per(
        submissions.where(F.col("submission_id").isNotNull()).select("submission_id", "certificate_file", SEQ),
        ["submission_id"],
    )
    refs = non_deleted(quotes).where(F.col("customer_ref_no").isNotNull()).select(
        "customer_ref_no", "quote_id"
    ).distinct()
    named = _named_files(chosen.join(first, "submission_id")).select("quote_id", "file_name").distinct()
    bundle = named.join(refs, "quote_id").select("customer_ref_no", "file_name").distinct()
    return keep_keys(bundle, files, ["file_name"])


def bundle_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files named by any of the rows, each once."""
    return keep_keys(_named_files(rows).select("file_name").distinct(), files, ["file_name"])


def missing_attachments(submissions: DataFrame, files: DataFrame) -> DataFrame:
    """Rows naming a file that is not in the store."""
    named = _named_files(submissions).select("submission_id", "quote_id", "part_no", "supplier", "file_name")
    return drop_keys(named, files, ["file_name"])


def attachments_to_purge(submissions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files of deleted quotes, by base name."""
    gone = keep_keys(_named_files(submissions), deleted, ["quote_id"])
    return gone.select(base_name(F.col("file_name")).alias("file_name")).where("file_name <> ''").distinct()
