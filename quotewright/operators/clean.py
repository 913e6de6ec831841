"""Landing text -> clean tables: missing values, dates, keys, statuses and flags.

Clean once and store: a filter on a clean status or flag reaches the Parquet scan, a filter on
``upper(trim(status))`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bundle import Tables
from ..functions import blank_to_null, clean_text, condition_code, status_code, strip, yes_no
from ..schemas import YES
from ..sources.tables import normalize_dates, null_tokens


def normalize_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Strip key columns; null stays null and never becomes a matching key."""
    return df.withColumns({c: strip(df[c].cast("string")) for c in cols})


def normalize_flag(df: DataFrame, col: str, default: str = "NO") -> DataFrame:
    """``YES`` / ``NO`` column, created with the default when absent."""
    return df.withColumn(col, yes_no(df[col], default) if col in df.columns else F.lit(default))


def normalize_condition(df: DataFrame, col: str = "cond_available") -> DataFrame:
    return df.withColumn(col, condition_code(df[col]))


def ensure_columns(df: DataFrame, cols: list[str], default: str = "") -> DataFrame:
    """Add the absent ones of ``cols`` with a constant, keep the present ones."""
    return df.withColumns({c: F.lit(default) for c in cols if c not in df.columns})


def certificate_rule(df: DataFrame) -> DataFrame:
    """Without a certificate its file and type are cleared; ``certificate_ok`` is false when one is
    claimed but no file is given."""
    claimed: Column = yes_no(df["certificate_available"]) == YES
    file = clean_text(df["certificate_file"])
    return df.withColumns(
        {
            "certificate_available": yes_no(df["certificate_available"]),
            "certificate_file": F.when(claimed, file).otherwise(F.lit("")),
            "certificate_type": F.when(claimed, clean_text(df["certificate_type"])).otherwise(F.lit("")),
            "certificate_ok": ~claimed | (file != ""),
        }
    )


def _dated(raw: DataFrame, few: DataFrame | None) -> DataFrame:
    """Missing values and dates; ``few`` are some rows of a table that is costly to read, see ``normalize_dates``."""
    return normalize_dates(null_tokens(raw), few=None if few is None else null_tokens(few))


def clean_quotes(raw: DataFrame, few: DataFrame | None = None) -> DataFrame:
    df = normalize_keys(_dated(raw, few), ["quote_id", "part_no", "customer_ref_no", "customer_id"])
    return df.withColumn("status", status_code(df["status"]))


def clean_assignments(raw: DataFrame) -> DataFrame:
    df = normalize_dates(null_tokens(raw))
    return normalize_keys(df, ["quote_id", "part_no", "assigned_to"])


def clean_submissions(raw: DataFrame, few: DataFrame | None = None) -> DataFrame:
    df = normalize_keys(_dated(raw, few), ["submission_id", "quote_id", "part_no", "worker_id"])
    df = normalize_flag(normalize_flag(df, "edit_required"), "no_quote")
    return df.withColumn("supplier", F.coalesce(blank_to_null(df["supplier"]), F.lit("")))


def clean_final_quotes(raw: DataFrame, few: DataFrame | None = None) -> DataFrame:
    df = normalize_keys(_dated(raw, few), ["quote_id", "part_no"])
    return df.withColumns(
        {
            "supplier": F.coalesce(blank_to_null(df["supplier"]), F.lit("")),
            "selected_submission_id": blank_to_null(df["selected_submission_id"]),
        }
    )


def clean_users(raw: DataFrame) -> DataFrame:
    return normalize_keys(null_tokens(raw), ["user_id", "username"])


def clean_tables(raw: Tables) -> Tables:
    return Tables(
        quotes=clean_quotes(raw.quotes),
        submissions=clean_submissions(raw.submissions),
        assignments=clean_assignments(raw.assignments),
        users=clean_users(raw.users),
        final_quotes=clean_final_quotes(raw.final_quotes),
    )
