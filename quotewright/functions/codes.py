"""Coded values: flags, statuses, condition codes, submission ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONDITIONS, NO, YES
from .text import strip


def yes_no(c: Column, default: str = NO) -> Column:
    """``YES`` or ``NO``; anything else, null included, is the default."""
    flag = F.upper(strip(c))
    return F.when(flag.isin(YES, NO), flag).otherwise(F.lit(default))


def status_code(c: Column) -> Column:
    return F.upper(strip(c))


def condition_code(c: Column) -> Column:
    """A known condition code, otherwise the first one."""
    code = strip(c)
    return F.when(code.isin(CONDITIONS), code).otherwise(F.lit(CONDITIONS[0]))


def is_true(c: Column) -> Column:
    """Booleans and their text forms; null is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))) == "true", F.lit(False))


def submission_number(c: Column) -> Column:
    """Digits of a ``SUB…`` id as a number, null for any other id."""
    return F.nullif(F.regexp_extract(c, r"^SUB(\d+)$", 1), F.lit("")).try_cast("bigint")


def submission_id(number: Column) -> Column:
    """``SUB`` and at least four digits; grows past four."""
    return F.format_string("SUB%04d", number)
