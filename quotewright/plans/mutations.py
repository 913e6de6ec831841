"""Batch changes of the desk: pure functions from tables and a batch of requests to new table content.

All tables are clean ones (``operators.clean``). A batch is a DataFrame, one row is the special case;
``_seq`` in a batch is the order of its requests. Where one batch names a key twice the outcome is that
of making the requests one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bundle import Tables
from ..functions import (
    as_of_text, attachment_name, blank_to_null, clean_text, condition_code, date_text, has_text,
    quote_id, strip, submission_id, to_date, to_number, yes_no,
)
from ..operators.changes import (
    append_numbered, delete_rows, set_status, update_rows,
)
from ..operators.filters import require_not_blank, require_not_null, reviewable, valid_offer, workers
from ..operators.joins import drop_keys, keep_keys, pair
from ..operators.latest import first_per, first_status, last_per
from ..operators.metrics import fully_submitted, pending_quotes
from ..operators.numbering import highest_seq, highest_submission_number, with_position
from ..schemas import (
    ALL_PARTS, ASSIGNED, COMPLETED, DELETED, NO, NO_QUOTE_LABEL, SEQ, SUBMITTED, UPLOADED, YES,
)
from ..session import materialize
from ..sources.tables import enforce_schema
from .pricing import chosen_rows

PART = ["quote_id", "part_no"]
OFFER = [*PART, "supplier"]


@dataclass(frozen=True)
class Top:
    """The highest ``_seq`` of a table and the highest submission number, where a change sees only a part of it."""

    seq: Column
    number: Column | None = None


def _fields(table: DataFrame, *without: str) -> list[str]:
    """Columns of a table but for the given ones and those that only travel along."""
    return [c for c in table.columns if c not in without and not c.startswith("_")]


# --- quotes ------------------------------------------------------------------------------------

def _by_supplier(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the blank supplier, and all others: no change of the one reaches the other, or has to shuffle it."""
    blank = F.coalesce(F.col("supplier") == "", F.lit(False))
    return submissions.where(blank), submissions.where(~blank)


def upload_preview(upload: DataFrame, number_type: str = "double") -> DataFrame:
    """Rows of an upload that can be shown for editing: part, description and a numeric quantity."""
    checked = upload.withColumn("qty", to_number(F.col("qty"), number_type))
    rows = require_not_null(checked, ["part_no", "description", "qty"])
    return rows.withColumn("quote_id", quote_id(F.col("customer_name"), F.col("customer_ref_no")))


def valid_upload(upload: DataFrame, as_of: str | Column | None = None, number_type: str = "double") -> DataFrame:
    """Rows of an upload that can be saved, in quote form: readable date and quantity, a part, a customer
    and a ref. No shuffle."""
    typed = upload.withColumns({"date": to_date(F.col("date")), "qty": to_number(F.col("qty"), number_type)})
    rows = require_not_null(typed, ["part_no", "qty", "date"])
    rows = require_not_blank(rows, ["customer_name", "customer_ref_no"])
    return rows.withColumns(
        {
            "quote_id": quote_id(F.col("customer_name"), F.col("customer_ref_no")),
            "date": F.col("date").cast("string"),
            "customer_name": strip(F.col("customer_name")),
            "customer_id": clean_text(F.col("customer_id")),
            "customer_ref_no": strip(F.col("customer_ref_no")),
            "cond": F.upper(F.col("cond")),
            "qty": F.col("qty").cast("string"),
            "due_date": date_text(F.col("due_date")),
            "status": F.lit(UPLOADED),
            "created_date": as_of_text(as_of),
        }
    )


def ingest_quotes(
    existing: DataFrame, upload: DataFrame, as_of: str | Column | None = None, number_type: str = "double",
    top: Top | None = None,
) -> DataFrame:
    """Append the valid rows of an upload; nothing is compared with the rows on file.

    ``_seq`` goes on from the largest one, keeping the order and the gaps of the upload, so rows are
    neither sorted nor shuffled.
    """
    rows = valid_upload(upload, as_of, number_type)
    lowest = upload.agg(F.min(SEQ)).scalar()
    highest = top.seq if top else highest_seq(existing)
    shifted = rows.withColumn(SEQ, highest + F.lit(1) + F.col(SEQ) - lowest)
    return existing.unionByName(enforce_schema(shifted, existing.schema))


def soft_delete(quotes: DataFrame, ids: DataFrame) -> DataFrame:
    return set_status(quotes, ids, "quote_id", DELETED)


def complete_refs(quotes: DataFrame, refs: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Complete every line of the refs; deleted lines too unless told to keep them."""
    return set_status(quotes, refs, "customer_ref_no", COMPLETED, [DELETED] if keep_deleted else None)


def deleted_quote_ids(quotes: DataFrame) -> DataFrame:
    return quotes.where((F.col("status") == DELETED) & (F.col("quote_id") != "")).select("quote_id").distinct()


def purge_deleted(tables: Tables) -> Tables:
    """Remove every quote with a deleted line from all four tables.

    The ids are written first: where they are measured to be few, no table is shuffled to look them up.
    """
    gone = materialize(deleted_quote_ids(tables.quotes), "deleted-quotes")
    return tables.updated(
        **{
            name: delete_rows(getattr(tables, name), gone, ["quote_id"])
            for name in ("quotes", "assignments", "submissions", "final_quotes")
        }
    )


def promote_submitted(quotes: DataFrame, submissions: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Set quotes with every part answered to submitted; ``only`` limits it to some quote ids."""
    asked, answers = quotes, submissions
    if only is not None:  # nothing of other quotes is counted
        asked, answers = keep_keys(quotes, only, ["quote_id"]), keep_keys(submissions, only, ["quote_id"])
    complete = fully_submitted(asked, answers)
    return set_status(quotes, complete, "quote_id", SUBMITTED)


# --- assignments -------------------------------------------------------------------------------

def accepted_assignments(quotes: DataFrame, assignments: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """The first request per quote that may go ahead: a pending, unassigned quote and a real worker.

    Requests carry (quote_id, worker_id, worker_due_date, ``_seq``).
    """
    able = workers(users, exact=True).select(F.col("user_id").alias("worker_id"))
    allowed = keep_keys(requests, able, ["worker_id"])
    allowed = keep_keys(allowed, pending_quotes(quotes), ["quote_id"])
    allowed = drop_keys(allowed, assignments, ["quote_id"])
    completed = first_status(quotes, "quote_id").where(F.col("first_status") == COMPLETED)
    return first_per(drop_keys(allowed, completed, ["quote_id"]), ["quote_id"])


def assignment_rows(
    quotes: DataFrame, assignments: DataFrame, users: DataFrame, requests: DataFrame, as_of: str | Column | None = None,
) -> DataFrame:
    """Accepted requests as rows of ``assignments``, in the order of ``_place``."""
    return accepted_assignments(quotes, assignments, users, requests).select(
        "quote_id", F.lit(ALL_PARTS).alias("part_no"), F.col("worker_id").alias("assigned_to"),
        as_of_text(as_of).alias("assigned_date"), date_text(F.col("worker_due_date")).alias("worker_due_date"),
        F.col(SEQ).alias("_place"),
    )


def assign_quotes(tables: Tables, requests: DataFrame, as_of: str | Column | None = None) -> Tables:
    """Assign whole quotes to workers and mark their open lines as assigned."""
    rows = assignment_rows(tables.quotes, tables.assignments, tables.users, requests, as_of)
    return tables.updated(
        assignments=append_numbered(tables.assignments, rows, "_place"),
        quotes=set_status(tables.quotes, rows, "quote_id", ASSIGNED, keep=[DELETED]),
    )


# --- offers: review ----------------------------------------------------------------------------

def edit_offers(submissions: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrite the reviewed fields by submission id; unknown ids are ignored, nulls do overwrite."""
    changes = last_per(edits.where(has_text(F.col("submission_id"))), ["submission_id"])
    texts = ["supplier_country", "cond_available", "lt", "remarks", "certificate_type"]

    def text(col: str):
        return lambda new: clean_text(new(col))

    setters = {c: text(c) for c in texts}
    setters["price"] = lambda new: F.when(to_number(new("price")).isNotNull(), strip(new("price")))
    setters["qty_available"] = lambda new: _whole(new("qty_available"))
    return update_rows(submissions, changes, ["submission_id"], setters)


def _whole(c: Column) -> Column:
    """Whole part of a number text, as text."""
    return to_number(c).cast("bigint").cast("string")


def send_back(submissions: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Send reviewable offers back for correction to a worker: (submission_id, worker_id, ``_seq``)."""
    able = workers(users).select(F.col("user_id").alias("worker_id"))
    allowed = keep_keys(requests, able, ["worker_id"])
    allowed = keep_keys(allowed, reviewable(submissions), ["submission_id"])
    changes = last_per(allowed, ["submission_id"])
    return update_rows(
        submissions, changes, ["submission_id"],
        {"edit_required": lambda new: F.lit(YES), "worker_id": lambda new: new("worker_id")},
    )


def attach_certificates(submissions: DataFrame, requests: DataFrame) -> DataFrame:
    """Record uploaded certificates: (submission_id, quote_id, part_no, supplier, certificate_type)."""
    named = requests.select(
        "submission_id", attachment_name(*[F.col(c) for c in OFFER]).alias("file"),
        blank_to_text(F.col("certificate_type")).alias("type"), SEQ,
    )
    # a request without a type keeps the type of an earlier request, or the one on file
    changes = named.groupBy("submission_id").agg(
        F.max_by("file", SEQ).alias("file"),
        F.max_by("type", F.when(F.col("type").isNotNull(), F.col(SEQ))).alias("type"),
    )
    return update_rows(
        submissions, changes, ["submission_id"],
        {
            "certificate_file": lambda new: new("file"),
            "certificate_available": lambda new: F.lit(YES),
            "certificate_type": lambda new: F.coalesce(new("type"), F.col("certificate_type")),
        },
    )


def blank_to_text(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


# --- offers: workers ---------------------------------------------------------------------------

def valid_submissions(requests: DataFrame, quotes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests for a part that exists in the open quotes and in the worker's tasks, on a quote that is
    not completed. ``tasks`` carries (worker_id, quote_id, part_no)."""
    lines = quotes.where((F.col("status") != DELETED) | F.col("status").isNull())
    completed = first_status(lines, "quote_id").where(F.col("first_status") == COMPLETED)
    known = keep_keys(keep_keys(requests, lines, PART), tasks, ["worker_id", *PART])
    return drop_keys(known, completed, ["quote_id"])


def rejected_submissions(requests: DataFrame, quotes: DataFrame, tasks: DataFrame) -> DataFrame:
    lines = quotes.where((F.col("status") != DELETED) | F.col("status").isNull())
    unknown = drop_keys(requests, lines, PART)
    not_held = drop_keys(keep_keys(requests, lines, PART), tasks, ["worker_id", *PART])
    return unknown.unionByName(not_held)


def offer_values(requests: DataFrame, as_of: str | Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Acceptable offer requests as submission rows without an id: supplier and price given, a claimed
    certificate comes with its file. ``carry`` names further columns to keep."""
    named = valid_offer(requests.withColumn("supplier", strip(F.col("supplier"))))
    claimed = yes_no(F.col("certificate_available"))
    file = clean_text(F.col("certificate_file"))
    complete = named.where((claimed == NO) | (file != ""))
    return complete.select(
        *OFFER, "supplier_country", "supplier_source", "price",
        condition_code(F.col("cond_available")).alias("cond_available"), "qty_available", "lt",
        claimed.alias("certificate_available"),
        F.when(claimed == YES, file).otherwise("").alias("certificate_file"),
        F.when(claimed == YES, F.col("certificate_type")).otherwise("").alias("certificate_type"),
        "remarks", "worker_id", as_of_text(as_of).alias("submitted_date"), F.lit(NO).alias("edit_required"),
        F.lit(NO).alias("no_quote"), F.lit("").alias("no_quote_remark"), SEQ, *carry,
    )


def upsert_offers(submissions: DataFrame, values: DataFrame, top: Top | None = None) -> DataFrame:
    """Upsert by (quote, part, supplier): a match keeps the id of its first row and replaces every other
    field, also the worker; new keys are appended with the next ids, in order of first request."""
    last = last_per(values, OFFER, _first=F.min(SEQ))
    # grouped before the shuffle and not looked up in the batch first, which would shuffle the batch's keys twice more
    on_file = submissions.where(F.col("supplier") != "").groupBy(*OFFER).agg(F.min_by("submission_id", SEQ).alias("_old_id"))
    resolved = pair(last, on_file.withColumn("_known", F.lit(True)), OFFER)
    # several steps read it: the known keys, the places of the others, their samples
    resolved = materialize(
        resolved.withColumn("_kept_id", blank_to_null(F.col("_old_id"))).drop("_old_id"), "resolved-offers")
    # only keys without an id need a place: the numbers are given out by it
    keeping = resolved.where(F.col("_kept_id").isNotNull()).withColumn("submission_id", F.col("_kept_id"))
    placed = with_position(resolved.where(F.col("_kept_id").isNull()), ["_first"], "_pos")
    number = (top.number if top else highest_submission_number(submissions)) + F.lit(1) + F.col("_pos")
    numbered = placed.withColumn("submission_id", submission_id(number))
    fresh = numbered.where(F.col("_known").isNull())
    known = keeping.unionByName(numbered.where(F.col("_known")).select(*keeping.columns))
    columns = _fields(submissions, *OFFER)
    setters = {c: (lambda new, c=c: new(c)) for c in columns}
    # an offer has a supplier, so the rows without one only travel along
    without, offers = _by_supplier(submissions)
    updated = update_rows(offers, known.select(*OFFER, *columns), OFFER, setters).unionByName(without)
    return append_numbered(updated, fresh, "_pos", submissions, top.seq if top else None)


def submit_offers(tables: Tables, requests: DataFrame, as_of: str | Column | None = None) -> Tables:
    """Take in supplier offers, then move their quotes on when all parts are answered."""
    values = materialize(offer_values(requests, as_of), "offer-values")  # several steps read them
    submissions = upsert_offers(tables.submissions, values)
    return tables.updated(
        submissions=submissions, quotes=promote_submitted(tables.quotes, submissions, only=values)
    )


def mark_no_quote(
    submissions: DataFrame, requests: DataFrame, as_of: str | Column | None = None, top: Top | None = None,
) -> DataFrame:
    """Record that a worker found no supplier: (quote_id, part_no, worker_id, remark, ``_seq``).

    Upsert by (quote, part, blank supplier, worker). Every valid request uses up an id, and the newest id
    replaces that of a row on file. A remark is required.
    """
    keys = [*PART, "worker_id"]
    wanted = requests.withColumn("remark", clean_text(F.col("remark"))).where(F.col("remark") != "")
    numbered = with_position(wanted.select(*keys, "remark", SEQ), [SEQ], "_pos")
    number = (top.number if top else highest_submission_number(submissions)) + F.lit(1) + F.col("_pos")
    last = last_per(numbered.withColumn("submission_id", submission_id(number)), keys, _place=F.min("_pos"))
    empty = ["supplier_country", "supplier_source", "cond_available", "lt", "certificate_file", "certificate_type"]
    fixed = {
        **{c: F.lit("") for c in empty},
        "price": F.lit(None).cast("string"), "qty_available": F.lit(None).cast("string"),
        "certificate_available": F.lit(NO), "remarks": F.lit(NO_QUOTE_LABEL),
        "submitted_date": as_of_text(as_of), "edit_required": F.lit(NO), "no_quote": F.lit(YES),
        "no_quote_remark": F.col("remark"), "supplier": F.lit(""),
    }
    rows = last.withColumns(fixed)
    columns = _fields(submissions, *keys, "supplier")
    setters = {c: (lambda new, c=c: new(c)) for c in columns}
    key = [*keys, "supplier"]
    without, offers = _by_supplier(submissions)  # rows with a supplier only travel along
    updated = update_rows(without, rows.select(*key, *columns), key, setters).unionByName(offers)
    new_rows = drop_keys(rows, without, key)
    return append_numbered(updated, new_rows, "_place", submissions, top.seq if top else None)


def resubmit(submissions: DataFrame, requests: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Correct sent-back offers by id; the price must be above zero.

    A claimed certificate keeps the file on file unless a new one comes along. The status of the quote is
    not looked at again.
    """
    priced = requests.where(has_text(F.col("submission_id")) & (to_number(F.col("price")) > 0))
    claimed = yes_no(F.col("certificate_available")) == YES
    checked = priced.withColumns(
        {
            "claimed": claimed,
            "new_file": blank_to_text(F.col("certificate_file")),
            "certificate_type": F.when(claimed, clean_text(F.col("certificate_type"))).otherwise(""),
            "cond_available": condition_code(F.col("cond_available")),
        }
    )
    changes = last_per(checked, ["submission_id"])
    plain = ["supplier_country", "supplier_source", "price", "cond_available", "qty_available", "lt", "remarks", "certificate_type"]
    setters = {c: (lambda new, c=c: new(c)) for c in plain}
    setters |= {
        "certificate_available": lambda new: F.when(new("claimed"), YES).otherwise(NO),
        "certificate_file": lambda new: F.when(
            new("claimed"), F.coalesce(new("new_file"), F.col("certificate_file"), F.lit(""))
        ).otherwise(""),
        "submitted_date": lambda new: as_of_text(as_of),
        "edit_required": lambda new: F.lit(NO),
        "no_quote": lambda new: F.lit(NO),
    }
    return update_rows(submissions, changes, ["submission_id"], setters)


def offer_from_no_quote(tables: Tables, requests: DataFrame, as_of: str | Column | None = None) -> Tables:
    """Turn no-quotes into offers: offer requests that also name the no-quote's ``submission_id``.

    The first request for a no-quote row overwrites it and keeps its id, even if the supplier already has
    a row for the part. The other requests go by (quote, part, supplier), as in ``upsert_offers``. Within
    one batch the no-quote rows are served first.
    """
    values = no_quote_values(requests, as_of)
    submissions = claim_no_quotes(tables.submissions, values)
    return tables.updated(
        submissions=submissions, quotes=promote_submitted(tables.quotes, submissions, only=values)
    )


def no_quote_values(requests: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Acceptable requests of ``offer_from_no_quote`` with the no-quote they name, written once: several steps read them."""
    values = offer_values(requests.withColumn("target", F.col("submission_id")), as_of, carry=("target",))
    return materialize(values, "offer-values")


def claim_no_quotes(submissions: DataFrame, values: DataFrame, top: Top | None = None) -> DataFrame:
    """Submissions after ``no_quote_values``: claimed no-quote rows overwritten, the other offers upserted."""
    open_rows = submissions.where((F.col("supplier") == "") & F.col("submission_id").isNotNull()).select(
        F.col("submission_id").alias("target")
    )
    claims = materialize(first_per(keep_keys(values, open_rows, ["target"]), ["target"]), "claims")
    rest = drop_keys(values, claims, [SEQ]).drop("target")
    changes = claims.withColumnRenamed("target", "submission_id").drop(SEQ).withColumn(
        "_new_supplier", F.col("supplier")
    ).withColumn("supplier", F.lit(""))
    columns = _fields(submissions, "submission_id", "supplier")
    setters = {c: (lambda new, c=c: new(c)) for c in columns}
    setters["supplier"] = lambda new: new("_new_supplier")
    without, offers = _by_supplier(submissions)
    claimed = update_rows(without, changes, ["submission_id", "supplier"], setters).unionByName(offers)
    return upsert_offers(claimed, rest, top)


# --- pricing -----------------------------------------------------------------------------------

def save_final(
    final_quotes: DataFrame, grid: DataFrame, as_of: str | Column | None = None, top: Top | None = None,
) -> DataFrame:
    """Replace the final rows of every quote in the grid by its ticked rows with a supplier."""
    grid = materialize(grid, "grid")  # its quotes and its rows are read
    kept = delete_rows(final_quotes, grid, ["quote_id"])
    rows = chosen_rows(grid).select(
        *OFFER, "price", "margin_percent", "final_unit_price", "final_total",
        F.col("submission_id").alias("selected_submission_id"), as_of_text(as_of).alias("generated_date"),
        "offer_seq", "description", "qty", "customer_due_date",
    )
    order = ["quote_id", "part_no", "offer_seq", "description", "qty", "customer_due_date"]
    placed = with_position(rows, order, "_pos")
    numbered = placed.withColumn(SEQ, (top.seq if top else highest_seq(final_quotes)) + F.lit(1) + F.col("_pos"))
    return kept.unionByName(enforce_schema(numbered, final_quotes.schema))
