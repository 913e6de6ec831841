"""Pricing: the margin grid, its preview, and the client quote, for all customer refs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    clean_text, cost_column, currency, final_total, final_unit_price, has_text, line_total,
    money_text, to_number,
)
from ..operators.filters import non_deleted, selected, supplier_offers
from ..operators.joins import drop_keys, expand, keep_keys, lookup, pair, split_join
from ..operators.latest import first_status, last_per
from ..operators.metrics import answered_parts
from ..schemas import BLANK_EDIT_MARGIN, COMPLETED, DEFAULT_MARGIN, SEQ
from ..session import materialize

PART = ["quote_id", "part_no"]


def ref_status(quotes: DataFrame) -> DataFrame:
    """Status and quote id of the first open line of each customer ref."""
    return first_status(non_deleted(quotes), "customer_ref_no")


def priced_lines(quotes: DataFrame) -> DataFrame:
    """Open part lines of refs that may still be priced (first status not completed)."""
    lines = non_deleted(quotes).where(F.col("customer_ref_no").isNotNull())
    locked = ref_status(quotes).where(F.col("first_status") == COMPLETED)
    return drop_keys(lines, locked, ["customer_ref_no"])


def offers_for_ref(submissions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Supplier offers for parts of each ref, carrying the ref."""
    parts = non_deleted(quotes).select("customer_ref_no", *PART).where(
        F.col("customer_ref_no").isNotNull()
    ).distinct()
    return supplier_offers(submissions).join(parts, PART)


def margin_progress(quotes: DataFrame, submissions: DataFrame) -> DataFrame:
    """Per ref: lock, and how many parts of its first quote have a supplier offer."""
    refs = ref_status(quotes)
    lines = non_deleted(quotes).where(F.col("customer_ref_no").isNotNull())
    requested = lines.groupBy("customer_ref_no", "quote_id").agg(F.count_distinct("part_no").alias("requested"))
    requested = requested.withColumnRenamed("quote_id", "first_quote_id")
    answered = answered_parts(submissions, include_no_quote=False).withColumnRenamed("quote_id", "first_quote_id")
    joined = pair(refs, requested, ["customer_ref_no", "first_quote_id"])
    joined = pair(joined, answered, ["first_quote_id"]).fillna(0, ["requested", "answered"])
    return joined.select(
        "customer_ref_no", "first_quote_id", "first_status", "requested", "answered",
        (F.col("first_status") == COMPLETED).alias("locked"),
        (F.col("answered") < F.col("requested")).alias("partial"),
    )


def saved_margins(final_quotes: DataFrame) -> DataFrame:
    """Margin of the latest saved row per submission: a submission saved twice does not double the grid."""
    saved = final_quotes.where(has_text(F.col("selected_submission_id"))).select(
        F.col("selected_submission_id").alias("submission_id"), "margin_percent", SEQ
    )
    return last_per(saved, ["submission_id"]).drop(SEQ)


def margin_grid(
    quotes: DataFrame, submissions: DataFrame, final_quotes: DataFrame, number_type: str = "double",
    default_margin: float = DEFAULT_MARGIN,
) -> DataFrame:
    """Part lines of every open ref with their supplier offers, margins and totals.

    A part without an offer keeps a row, a ref without any offer has none. Parts with and without offers go separate
    ways: a part with very many offers can be split in the inner join, and only the parts without one have to look at
    the rest of their ref. The lines are read by each of these ways and written once: each would join and shuffle all
    open lines again. Margins join the parts with offers, which are fewer than all offers and have a submission id each;
    on the finished grid the parts without an offer would all share the null key.
    """
    lines = materialize(priced_lines(quotes).select(
        *PART, "customer_ref_no", "description", "qty", "due_date"
    ).distinct(), "priced-lines")
    lines = lines.where(F.col("customer_ref_no").isNotNull())  # all are; said here, it is said of both shuffles of the lines
    cost = cost_column(submissions)
    offers = supplier_offers(submissions).select(
        "submission_id", *PART, "supplier", "supplier_country",
        to_number(F.col(cost), number_type).alias("price"),
        clean_text(F.col("cond_available")).alias("condition"), clean_text(F.col("lt")).alias("lead_time"),
        F.col(SEQ).alias("offer_seq"),
    )
    with_offer, without = split_join(lines, offers, PART)
    with_offer = lookup(with_offer, saved_margins(final_quotes), ["submission_id"])
    offered = keep_keys(lines.select("customer_ref_no", *PART), offers, PART)
    without = keep_keys(without, offered, ["customer_ref_no"])
    grid = with_offer.unionByName(without, allowMissingColumns=True)
    return priced(
        grid.withColumn("select", F.lit(True)).withColumnRenamed("due_date", "customer_due_date"),
        number_type, default_margin,
    )


GRID = [
    "select", "submission_id", "quote_id", "customer_ref_no", "part_no", "description", "qty",
    "customer_due_date", "supplier", "supplier_country", "condition", "lead_time", "price", "total_price",
    "margin_percent", "final_unit_price", "final_total", "offer_seq",
]


def priced(grid: DataFrame, number_type: str, default_margin: float) -> DataFrame:
    """Fill price 0, quantity 1 and the default margin, and compute the totals."""
    numbers = grid.withColumns(
        {
            "price": to_number(F.col("price"), number_type, 0.0),
            "qty": to_number(F.col("qty"), number_type, 1.0),
            "margin_percent": to_number(F.col("margin_percent"), number_type, default_margin),
        }
    )
    price, margin, qty = F.col("price"), F.col("margin_percent"), F.col("qty")
    return numbers.withColumns(
        {
            "total_price": line_total(price, qty),
            "final_unit_price": final_unit_price(price, margin),
            "final_total": final_total(price, margin, qty),
        }
    ).select(GRID)


def edited_grid(grid: DataFrame, edits: DataFrame, number_type: str = "double") -> DataFrame:
    """The grid after edits: per (quote, part, submission) a tick and a margin text.

    The margin of an edited row that is blank or no number counts as 0, not as the default. A later
    edit of the same row wins.
    """
    keys = [*PART, "submission_id"]
    last = last_per(edits.where(F.col("submission_id").isNotNull()), keys)
    change = last.select(*keys, F.struct("margin_percent", "select").alias("_edit"))
    joined = lookup(grid, change, keys)
    edited = F.col("_edit").isNotNull()
    changed = joined.withColumns(
        {
            "margin_percent": F.when(edited, F.col("_edit.margin_percent").cast("string"))
            .otherwise(F.col("margin_percent").cast("string")),
            "select": F.when(edited, F.col("_edit.select").cast("string"))
            .otherwise(F.col("select").cast("string")),
        }
    )
    return priced(changed.drop("_edit"), number_type, BLANK_EDIT_MARGIN)


def chosen_rows(grid: DataFrame) -> DataFrame:
    """Ticked rows that name a supplier."""
    return selected(grid).where(has_text(F.col("supplier")))


def margin_preview(grid: DataFrame) -> DataFrame:
    return chosen_rows(grid).select(
        "customer_ref_no", "part_no", "supplier", "price", "total_price", "margin_percent",
        "final_unit_price", "final_total",
    )


def internal_quote(grid: DataFrame) -> DataFrame:
    return grid.select(
        F.col("customer_ref_no").alias("ref_no"), "part_no", "description", "qty", "supplier", "condition",
        "lead_time", "price", "total_price", "margin_percent", "final_unit_price", "final_total",
        "customer_due_date",
    )


def exportable_lines(final_quotes: DataFrame, submissions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Final rows with their submission (if any) and every open part line of the same part.

    Final rows without an open part line belong to no ref and drop out.
    """
    offers = submissions.select(
        F.col("submission_id").alias("selected_submission_id"), *PART, "cond_available", "lt",
        "certificate_type", "certificate_file",
    )
    final = final_quotes.select(
        "selected_submission_id", *PART, "supplier", "final_unit_price", "final_total"
    )
    lines = non_deleted(quotes).where(F.col("customer_ref_no").isNotNull()).select(
        *PART, "customer_id", "customer_ref_no", "description", "qty"
    )
    joined = expand(final, offers, ["selected_submission_id", *PART])
    return joined.join(lines, PART).withColumn("select", F.lit(True))


def export_blockers(lines: DataFrame) -> DataFrame:
    """Ticked rows without a chosen submission; one of them blocks its whole ref."""
    return selected(lines).where(~has_text(F.col("selected_submission_id"))).select(
        "customer_ref_no", *PART, "supplier"
    )


def client_quote(lines: DataFrame) -> DataFrame:
    """What the customer gets: the ticked rows of every ref without a blocker, prices as ``$`` text."""
    ready = drop_keys(selected(lines), export_blockers(lines), ["customer_ref_no"])
    return ready.select(
        "customer_id", F.col("customer_ref_no").alias("ref_no"), "part_no", "description", "qty",
        currency(money_text(F.col("final_unit_price"))).alias("unit_price"),
        currency(money_text(F.col("final_total"))).alias("total_price"),
        F.col("cond_available").alias("condition"), F.col("lt").alias("lead_time_days"),
        "certificate_type", "certificate_file",
    )
