"""Table layouts, the CSV headings they land with, and the fixed value domains.

Landing columns are text; ``_seq`` is the row order of the source and replaces any reliance on
physical order (see ``sources.tables.read_table``).
"""

from __future__ import annotations

from pyspark.sql import types as T

SEQ = "_seq"

# --- fixed values: file headings, in file order ------------------------------------------------
USERS_HEADINGS = ["USER_ID", "USERNAME", "ROLE"]
QUOTES_HEADINGS = [
    "QUOTE_ID", "SL NO", "DATE", "CUSTOMER NAME", "CUSTOMER ID", "Customer ref NO", "PART NO",
    "DESCRIPTION", "COND", "QTY", "DUE DATE", "STATUS", "CREATED_DATE",
]
UPLOAD_HEADINGS = [
    "SL NO", "DATE", "CUSTOMER NAME", "CUSTOMER ID", "Customer ref NO", "PART NO", "DESCRIPTION",
    "QTY", "COND", "DUE DATE",
]
ASSIGNMENTS_HEADINGS = ["QUOTE_ID", "PART NO", "ASSIGNED_TO", "ASSIGNED_DATE", "WORKER_DUE_DATE"]
SUBMISSIONS_HEADINGS = [
    "SUBMISSION_ID", "QUOTE_ID", "PART NO", "SUPPLIER", "SUPPLIER_COUNTRY", "SUPPLIER_SOURCE",
    "PRICE", "COND_AVAILABLE", "QTY_AVAILABLE", "LT", "CERTIFICATE_AVAILABLE", "CERTIFICATE_FILE",
    "CERTIFICATE_TYPE", "REMARKS", "WORKER_ID", "SUBMITTED_DATE", "EDIT_REQUIRED", "NO_QUOTE",
    "NO_QUOTE_REMARK",
]
FINAL_QUOTES_HEADINGS = [
    "QUOTE_ID", "PART NO", "SUPPLIER", "PRICE", "MARGIN_PERCENT", "FINAL_UNIT_PRICE",
    "FINAL_TOTAL", "SELECTED_SUBMISSION_ID", "GENERATED_DATE",
]

# --- fixed values: domains ---------------------------------------------------------------------
UPLOADED, ASSIGNED, SUBMITTED = "UPLOADED", "ASSIGNED", "SUBMITTED"
COMPLETED, DELETED = "COMPLETED", "DELETED"
CONDITIONS = ["NE", "NS", "OH", "SV", "AR", "FN", "MOD", "RP", "IN"]
YES, NO = "YES", "NO"
ALL_PARTS = "ALL"
NO_QUOTE_LABEL = "NO QUOTE"
DEFAULT_UNIT = "EA"
WORKER_ROLE = "worker"
DEFAULT_MARGIN = 15.0
BLANK_EDIT_MARGIN = 0.0
# Text that counts as "no supplier", compared in lower case after stripping.
BLANK_TOKENS = ["", "nan", "none"]
# Text that a CSV reader turns into null (the pandas default list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def column_name(heading: str) -> str:
    """File heading -> column name: ``Customer ref NO`` -> ``customer_ref_no``."""
    return heading.strip().lower().replace(" ", "_")


def rename_map(headings: list[str]) -> dict[str, str]:
    return {h: column_name(h) for h in headings}


def _text_schema(headings: list[str], **typed: T.DataType) -> T.StructType:
    fields = [
        T.StructField(column_name(h), typed.get(column_name(h), T.StringType())) for h in headings
    ]
    return T.StructType(fields + [T.StructField(SEQ, T.LongType())])


MONEY = T.DecimalType(18, 2)
PRICED = T.DecimalType(18, 4)

USERS = _text_schema(USERS_HEADINGS)
QUOTES = _text_schema(QUOTES_HEADINGS)
UPLOAD = _text_schema(UPLOAD_HEADINGS)
ASSIGNMENTS = _text_schema(ASSIGNMENTS_HEADINGS)
SUBMISSIONS = _text_schema(SUBMISSIONS_HEADINGS)
FINAL_QUOTES = _text_schema(
    FINAL_QUOTES_HEADINGS,
    price=MONEY, margin_percent=T.DecimalType(6, 2), final_unit_price=PRICED, final_total=PRICED,
)

# One offer request as a worker sends it; ``_seq`` is the order of arrival.
OFFER_REQUEST_COLUMNS = [
    "quote_id", "part_no", "supplier", "supplier_country", "supplier_source", "price",
    "cond_available", "qty_available", "lt", "certificate_available", "certificate_file",
    "certificate_type", "remarks", "worker_id",
]
OFFER_REQUESTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in OFFER_REQUEST_COLUMNS]
    + [T.StructField(SEQ, T.LongType())]
)
