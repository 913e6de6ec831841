"""Connected components of links between rows, by alternating large and small stars.

Each step is an aggregate with map-side combine and a join, written to the shared folder; nothing about nodes
or links reaches the driver but a count. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fresh_keys
from ..session import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least neighbour of u; a node with many edges can be split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(fresh_keys(least, ["u"]), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    starred = _with_least(both).where(F.col("v") > F.col("u"))
    return starred.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are hung on the least of them."""
    starred = _with_least(edges)
    below = starred.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(starred.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node reachable, for every node that has a link to another.

    Links may come in either direction and repeatedly; nulls and links of a node to itself do not count.
    """
    ends = links.where(F.col(a) != F.col(b))
    edges = ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        edges = materialize(_small_star(materialize(_large_star(edges), "stars")), "stars")
        # the round that changes nothing is the last: every node hangs on its root
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
