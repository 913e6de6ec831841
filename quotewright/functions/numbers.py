"""Numbers out of text, and the price arithmetic.

Prices work on whatever numeric type they are given: ``double`` by default, decimal for exact money.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Cost columns in order of preference (fixed values).
COST_COLUMNS = ["price", "cost_price_ea", "cost"]


def to_number(c: Column, dtype: str | T.DataType = "double", default: float | None = None) -> Column:
    """Number from text, anything else null (or ``default``).

    The pattern guards the cast: a bare ``try_cast`` reads ``12d`` as 12.
    """
    text = c.cast("string")
    number = F.when(text.rlike(_NUMERIC), text.try_cast(dtype))
    return number if default is None else F.coalesce(number, F.lit(default).cast(dtype))


def line_total(price: Column, qty: Column) -> Column:
    return price * qty


def final_unit_price(price: Column, margin_percent: Column) -> Column:
    return price * (F.lit(1) + margin_percent / F.lit(100))


def final_total(price: Column, margin_percent: Column, qty: Column) -> Column:
    return final_unit_price(price, margin_percent) * qty


def money_text(c: Column, scale: int = 4) -> Column:
    """Plain decimal text; a large double would otherwise print as ``1.0E7``."""
    return c.cast(T.DecimalType(38, scale)).cast("string")


def cost_column(df: DataFrame) -> str:
    """The first cost column the frame has, decided when the plan is built."""
    return next((name for name in COST_COLUMNS if name in df.columns), COST_COLUMNS[-1])
