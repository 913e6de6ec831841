"""Scalar functions: Column -> Column, all built on Spark's own expressions (no Python UDF)."""

from .codes import (
    condition_code, is_true, status_code, submission_id, submission_number, yes_no,
)
from .dates import as_of_text, date_text, to_date
from .numbers import cost_column, final_total, final_unit_price, line_total, money_text, to_number
from .text import (
    attachment_name, base_name, blank_to_null, clean_text, currency, has_text, is_blank, label,
    null_if_token, quote_id, safe_filename, safe_ref, strip,
)

__all__ = [
    "as_of_text", "attachment_name", "base_name", "blank_to_null", "clean_text",
    "condition_code", "cost_column", "currency", "date_text", "final_total", "final_unit_price",
    "has_text", "is_blank", "is_true", "label", "line_total", "money_text", "null_if_token",
    "quote_id", "safe_filename", "safe_ref", "status_code", "strip", "submission_id",
    "submission_number", "to_date", "to_number", "yes_no",
]
