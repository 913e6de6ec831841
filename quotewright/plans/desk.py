"""Desk views: master quotes, assignment state, offer review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, to_number
from ..operators.clean import ensure_columns
from ..operators.filters import filter_in, filter_text, no_quotes, reviewable, split_by_status
from ..operators.joins import lookup
from ..operators.latest import last_assignment
from ..schemas import ASSIGNED, NO_QUOTE_LABEL


def master_quotes(
    quotes: DataFrame, bucket: str, patterns: dict[str, str] | None = None, statuses: list[str] | None = None,
) -> DataFrame:
    """Active, archive or deleted quotes with the optional filters of the list."""
    shown = filter_in(filter_text(split_by_status(quotes)[bucket], patterns or {}), {"status": statuses or []})
    return shown.drop("sl_no")


def user_names(users: DataFrame, id_name: str, name: str) -> DataFrame:
    return users.where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias(id_name), F.col("username").alias(name)
    )


def assigned_parts(quotes: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Parts in work with the worker of the quote's last assignment."""
    parts = quotes.where(F.col("status") == ASSIGNED).select(
        "quote_id", "part_no", "description", "qty", "status"
    )
    last = last_assignment(assignments).select("quote_id", "assigned_to", "assigned_date", "worker_due_date")
    named = lookup(last, user_names(users, "assigned_to", "assigned_to_user"), ["assigned_to"])
    return lookup(parts, named.drop("assigned_to"), ["quote_id"]).select(
        "quote_id", "part_no", "description", "qty", "status", "assigned_to_user", "assigned_date",
        "worker_due_date",
    )


def part_details(submissions: DataFrame, quotes: DataFrame, users: DataFrame) -> DataFrame:
    """All submissions with customer ref, description and worker name.

    A part asked for with two descriptions gives two rows. Exact copies of a part line are collapsed
    before the join, inside each task.
    """
    lines = quotes.where(F.col("quote_id").isNotNull() & F.col("part_no").isNotNull()).select(
        "quote_id", "part_no", "customer_ref_no", "description"
    ).distinct()
    with_lines = lookup(submissions, lines, ["quote_id", "part_no"])
    return lookup(with_lines, user_names(users, "worker_id", "worker_name"), ["worker_id"])


OFFER_DETAIL_TEXT = [
    "supplier", "supplier_country", "supplier_source", "cond_available", "lt", "remarks",
    "certificate_type", "worker_name", "submitted_date",
]


def offer_details(
    submissions: DataFrame, quotes: DataFrame, users: DataFrame, patterns: dict[str, str] | None = None,
    worker_names: list[str] | None = None, number_type: str = "double",
) -> DataFrame:
    """Offers ready for review, one display row each."""
    shown = part_details(reviewable(submissions), quotes, users)
    shown = filter_in(filter_text(shown, patterns or {}), {"worker_name": worker_names or []})
    shown = ensure_columns(shown, OFFER_DETAIL_TEXT)
    texts = [clean_text(F.col(c)).alias(c) for c in OFFER_DETAIL_TEXT]
    return shown.select(
        "submission_id", "quote_id", "customer_ref_no", "part_no", *texts,
        to_number(F.col("price"), number_type).alias("price"),
        to_number(F.col("qty_available"), number_type).alias("qty_available"),
    )


def no_quote_report(submissions: DataFrame, quotes: DataFrame, users: DataFrame) -> DataFrame:
    """Parts nobody could source, for all workers."""
    return part_details(no_quotes(submissions), quotes, users).select(
        F.col("customer_ref_no").alias("ref_no"), "part_no", "description",
        F.col("worker_name").alias("worker"), F.col("no_quote_remark").alias("remark"),
        F.col("submitted_date").alias("date"), F.lit(NO_QUOTE_LABEL).alias("status"),
    )
