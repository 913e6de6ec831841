"""The join shapes of the library and how each stands up to a hot key.

``lookup``   the right side has one row per key, so a hot key only swells the left side, which
             Spark's skew join splits at run time.
``pair``     both sides have one row per key: nothing to split, and no shuffle beyond that of the
             aggregates they come from.
``expand``   the right side may have many rows per key. An outer join could not split a hot right
             side, so matches go through an inner join (either side splits) and the rest through an
             anti join on distinct keys.
``keep_keys`` / ``drop_keys``
             semi / anti join on distinct keys; the distinct runs inside each task first, so a hot key
             arrives at most once per task.

Spark only splits a join whose two inputs come straight from a shuffle. A right side that was just
aggregated by the join keys would be joined where it lies, without one, and a hot left key would stay in
one task. ``fresh_keys`` makes Spark shuffle such a side again: one row per key moves once more, so that
the side with all the rows can be split.

No side is broadcast by hint; Spark does it where the measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def fresh_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, with keys that Spark no longer takes to be partitioned."""
    return df.withColumns({k: F.greatest(F.col(k), F.col(k)) for k in keys})


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a right side that is unique by ``keys``."""
    return left.join(fresh_keys(right, keys), keys, "left")


def pair(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two sides that are both unique by ``keys``."""
    return left.join(right, keys, "left")


def split_join(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner join, left rows without a match) for a right side with any number of rows per key.

    Rows with a null key never match and skip the shuffle, where they would all meet in one task. Both
    results start from the same shuffle of the left side, which Spark runs once.
    """
    # said of the fresh keys as well, as Spark does for the inner join: else the two would not be the same shuffle
    keyed = fresh_keys(left.where(_all_present(keys)), keys).where(_all_present(keys))
    keyless = left.where(~_all_present(keys))
    matched = keyed.join(fresh_keys(right.where(_all_present(keys)), keys), keys)
    return matched, drop_keys(keyed, right, keys).unionByName(keyless)


def expand(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a right side with any number of rows per key."""
    matched, unmatched = split_join(left, right, keys)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def _distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return fresh_keys(df.select(*keys).where(_all_present(keys)).distinct(), keys)


def keep_keys(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys_of``; a null key never occurs."""
    return df.join(_distinct_keys(keys_of, keys), keys, "left_semi")


def drop_keys(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys_of``; a null key never occurs."""
    return df.join(_distinct_keys(keys_of, keys), keys, "left_anti")
