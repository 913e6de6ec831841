"""Set-based changes: update, delete and upsert for any number of keys at once.

Tables are never changed in place: each function returns the new content of a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEQ
from .joins import drop_keys, lookup
from .numbering import highest_seq

Setter = Callable[[Callable[[str], Column]], Column]


def update_rows(base: DataFrame, changes: DataFrame, keys: list[str], set_: dict[str, Setter]) -> DataFrame:
    """Set columns of the rows whose key is in ``changes``; a matched null does overwrite.

    ``changes`` must be unique by key (``last_per`` makes it so). Each setter gets a function that
    returns a column of the change row.
    """
    values = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, F.struct(F.lit(True).alias("_hit"), *values).alias("_new"))
    joined = lookup(base, marked, keys)

    def new(col: str) -> Column:
        return F.col(f"_new.`{col}`")

    hit = F.col("_new._hit").isNotNull()
    return joined.select(
        [
            F.when(hit, set_[f.name](new).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in set_ else F.col(f.name)
            for f in base.schema.fields
        ]
    )


def set_status(quotes: DataFrame, keys_of: DataFrame, key: str, status: str, keep: list[str] | None = None) -> DataFrame:
    """Set the status of all lines of the given quotes or refs, except lines in a status to keep."""
    ids = keys_of.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_status", F.lit(status))
    joined = lookup(quotes, ids, [key])
    kept = F.coalesce(F.col("status").isin(keep), F.lit(False)) if keep else F.lit(False)
    changed = F.when(~kept & F.col("_status").isNotNull(), F.col("_status")).otherwise(F.col("status"))
    return joined.withColumn("status", changed).select(*quotes.columns)


def delete_rows(base: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return drop_keys(base, keys_of, keys).select(*base.columns)


def append_numbered(
    base: DataFrame, new: DataFrame, place: str, stored: DataFrame | None = None, top: Column | None = None,
) -> DataFrame:
    """Append rows; ``_seq`` goes on above the largest one in the order of the column ``place`` (>= 0).

    ``stored`` is the table to take that maximum from when ``base`` is a change of it with the same rows; ``top`` is
    the maximum itself, where ``base`` is only a part of the table. Columns that the new rows lack are null.
    """
    if top is None:
        top = highest_seq(base if stored is None else stored)
    numbered = new.withColumn(SEQ, top + F.lit(1) + F.col(place))
    columns = [
        (F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in base.schema.fields
    ]
    return base.unionByName(numbered.select(columns))
