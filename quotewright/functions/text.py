"""Text cleaning, keys and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLANK_TOKENS, NULL_TOKENS

# Every character Python counts as white space; Spark's one-argument trim removes spaces only.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Stripped text, null as the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, empty, or one of the words that stand for nothing; never null itself."""
    return F.coalesce(F.lower(strip(c)).isin(BLANK_TOKENS), F.lit(True))


def has_text(c: Column) -> Column:
    return ~is_blank(c)


def blank_to_null(c: Column) -> Column:
    return F.when(has_text(c), strip(c))


def null_if_token(c: Column) -> Column:
    """What a CSV reader would read as missing becomes null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def _id_part(c: Column, default: str) -> Column:
    collapsed = F.regexp_replace(strip(c), _SPACE_RUN, " ")
    return F.coalesce(F.nullif(collapsed, F.lit("")), F.lit(default))


def quote_id(customer_name: Column, customer_ref: Column) -> Column:
    """``NAME_REF`` with runs of white space collapsed."""
    return F.concat(_id_part(customer_name, "UNKNOWN"), F.lit("_"), _id_part(customer_ref, "NOREF"))


def safe_filename(c: Column) -> Column:
    safe = F.btrim(F.regexp_replace(clean_text(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("NA"))


def attachment_name(quote: Column, part: Column, supplier: Column) -> Column:
    stem = F.concat_ws("_", safe_filename(quote), safe_filename(part), safe_filename(supplier))
    return F.concat(stem, F.lit(".pdf"))


def safe_ref(c: Column) -> Column:
    return F.translate(c, " /", "_-")


def base_name(path: Column) -> Column:
    """Last component of a path, ignoring trailing slashes."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def label(*parts: Column) -> Column:
    """Parts joined with `` | ``, nulls as empty text, ``N/A`` when nothing is left."""
    joined = strip(F.concat_ws(" | ", *[clean_text(p) for p in parts]))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("N/A"))


def currency(c: Column) -> Column:
    """Prefix ``$`` unless the text is missing, blank or already prefixed."""
    text = c.cast("string")
    keep = text.isNull() | (strip(text) == "") | strip(text).startswith("$")
    return F.when(keep, text).otherwise(F.concat(F.lit("$"), text))
