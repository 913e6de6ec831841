"""Row filters. Flag and status filters expect clean tables, where they reach the Parquet scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, has_text, is_true, strip, to_date, to_number
from ..schemas import COMPLETED, DELETED, NO, WORKER_ROLE, YES


def filter_text(df: DataFrame, patterns: dict[str, str | None], literal: bool = False) -> DataFrame:
    """Case-insensitive pattern per column, all must hold; an empty pattern or absent column is no
    filter, a null value never matches. ``literal`` takes the text as it is instead of as a regex."""
    for col, pattern in patterns.items():
        if pattern and col in df.columns:
            regex = "(?i)" + (re.escape(pattern) if literal else pattern)
            df = df.where(F.col(f"`{col}`").cast("string").rlike(regex))
    return df


def filter_in(df: DataFrame, choices: dict[str, list[str]]) -> DataFrame:
    """Value lists per column, all must hold; an empty list or absent column is no filter."""
    for col, values in choices.items():
        if values and col in df.columns:
            df = df.where(F.col(f"`{col}`").isin(values))
    return df


def split_by_status(quotes: DataFrame) -> dict[str, DataFrame]:
    """Quotes as active, archive (completed) and deleted; a null status is active."""
    status = F.coalesce("status", F.lit(""))
    return {
        "active": quotes.where(~status.isin(COMPLETED, DELETED)),
        "archive": quotes.where(F.col("status") == COMPLETED),
        "deleted": quotes.where(F.col("status") == DELETED),
    }


def non_deleted(quotes: DataFrame) -> DataFrame:
    return quotes.where((F.col("status") != DELETED) | F.col("status").isNull())


def require_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def require_not_blank(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [clean_text(F.col(c)) != "" for c in cols]))


def supplier_offers(submissions: DataFrame) -> DataFrame:
    """Submissions that offer something: a named supplier and not marked as no-quote."""
    return submissions.where((F.col("no_quote") == NO) & has_text(F.col("supplier")))


def reviewable(submissions: DataFrame) -> DataFrame:
    return submissions.where((F.col("edit_required") == NO) & (F.col("no_quote") == NO))


def no_quotes(submissions: DataFrame) -> DataFrame:
    return submissions.where(F.col("no_quote") == YES)


def sent_back(submissions: DataFrame) -> DataFrame:
    return submissions.where((F.col("edit_required") == YES) & (F.col("no_quote") != YES))


def selected(df: DataFrame, col: str = "select") -> DataFrame:
    """Rows ticked in a grid; the tick may be a boolean or text."""
    return df.where(is_true(F.col(f"`{col}`")))


def workers(users: DataFrame, exact: bool = False) -> DataFrame:
    role = F.col("role") if exact else F.lower(strip(F.col("role")))
    return users.where(role == WORKER_ROLE)


def for_worker(df: DataFrame, worker_id: str, col: str = "worker_id") -> DataFrame:
    return df.where(F.col(col) == worker_id)


def for_ref(df: DataFrame, ref: str) -> DataFrame:
    return df.where(F.col("customer_ref_no") == ref.strip())


def valid_offer(df: DataFrame) -> DataFrame:
    """Offers with a supplier and a price above zero."""
    return df.where(has_text(F.col("supplier")) & (to_number(F.col("price")) > 0))


def quality_report(quotes: DataFrame, submissions: DataFrame, final_quotes: DataFrame) -> DataFrame:
    """One row per check: rows looked at and rows that fail, one pass over each table."""
    checks = [
        (quotes, "quotes", {
            "date": to_date(F.col("date")).isNull(),
            "qty": to_number(F.col("qty")).isNull(),
            "part_no": F.col("part_no").isNull(),
        }),
        (submissions, "submissions", {
            "supplier": ~has_text(F.col("supplier")),
            "price": ~F.coalesce(to_number(F.col("price")) > 0, F.lit(False)),
        }),
        (final_quotes, "final_quotes", {
            "selected_submission_id": ~has_text(F.col("selected_submission_id")),
        }),
    ]
    reports = []
    for df, table, failing in checks:
        counted = df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in failing.items()]
        )
        pairs = [F.struct(F.lit(n).alias("check"), F.col(n).alias("failed")) for n in failing]
        reports.append(
            counted.select("rows", F.explode(F.array(*pairs)).alias("c")).select(
                F.lit(table).alias("table_name"), F.col("c.check").alias("check_name"),
                F.col("rows").alias("row_count"), F.col("c.failed").alias("failed_count"),
            )
        )
    return reduce(DataFrame.unionByName, reports)
