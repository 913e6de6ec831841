"""Dates out of text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts (fixed values). ISO dates are read by Spark's own cast, several times faster than a
# format pattern; the cast alone would also take ``2024`` or ``2024-01-05 junk``, hence the guard.
_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?Z?)?\s*$"
_SLASHED = ["yyyy/M/d", "M/d/yyyy"]


def to_date(c: Column, formats: list[str] | None = None) -> Column:
    """Date from text, anything else null. ``formats`` replaces the accepted layouts."""
    text = c.cast("string")
    if formats:
        return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])
    slashed = F.coalesce(*[F.try_to_date(F.trim(text), f) for f in _SLASHED])
    return F.when(text.rlike(_ISO), text.try_cast("date")).when(text.contains("/"), slashed)


def date_text(c: Column, formats: list[str] | None = None) -> Column:
    """Date as ``yyyy-MM-dd`` text, the empty string where nothing parses."""
    return F.coalesce(to_date(c, formats).cast("string"), F.lit(""))


def as_of_text(as_of: str | dt.date | Column | None = None) -> Column:
    """The business date as text; today unless given."""
    if as_of is None:
        as_of = F.current_date()
    elif isinstance(as_of, dt.date):
        as_of = F.lit(as_of)
    elif isinstance(as_of, str):
        as_of = F.lit(as_of).cast("date")
    return as_of.cast("string")
