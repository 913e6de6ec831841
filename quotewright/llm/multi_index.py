"""Near-duplicate embeddings by an inverted multi-index, verified by cosine in double precision.

Each half of a unit vector has a codebook of its own; the pairs of codewords form a grid of cells. Every vector
lies in the cell of its nearest codewords and, as a query, visits cells in the order of its distance to them
(multi-sequence traversal: the two sorted distance lists are merged cell by cell). All vectors of the visited
cells are verified, in blocks of bounded size, so a full cell is many small tasks.

How many cells a query visits has no bound: it is what it takes to reach the target recall, both for a sample of
queries compared with all rows by brute force, each query with the same weight, and for copies of the sample moved
to a cosine of just the threshold. Codebooks come from the sample in several sizes, down to a single cell, which is
brute force; that with the least work is taken. Every vector is indexed and every vector queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fresh_keys
from ..session import materialize
from .common import prepare
from .components import components

SIMILARITY = 0.9
#: Rows that codebooks are fitted on, and of them queries that are compared with all rows, at most.
SAMPLE, QUERIES = 4096, 256
#: Part of a query's links, and of the moved copies, whose cell a query must visit.
TARGET_RECALL = 0.99
#: Comparisons that cost as much as sending a vector to a cell: the network and disks are what is short at scale.
SENT = 1000
#: Vectors in a cell, on average, that the number of codewords aims at, and the most codewords of a half.
PER_CELL, CODEWORDS = 8, 512
#: Vectors in a block of a cell.
BLOCK = 256
#: Lengths with an index of their own, at most, and how many vectors one must have; all other lengths have one cell.
LENGTHS, LARGE = 16, 4096
#: Cells are numbered within a length.
WIDE = 1 << 20


@dataclass(frozen=True)
class MultiIndex:
    halves: tuple[np.ndarray, np.ndarray]
    visits: int

    @property
    def cells(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each vector's halves to the codewords."""
        middle = unit.shape[1] // 2
        return [(part**2).sum(1)[:, None] - 2 * part @ words.T + (words**2).sum(1)
                for part, words in zip((unit[:, :middle], unit[:, middle:]), self.halves)]

    def home(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.distances(unit)
        return first.argmin(1) * len(self.halves[1]) + second.argmin(1)

    def traverse(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """Cells in the order of distance, for each vector.

        The cell of the r-th and s-th nearest codewords has (r + 1) * (s + 1) - 1 cells before it at least, so
        only pairs of places within that bound are merged.
        """
        first, second = self.distances(unit)
        wanted = min(visits or self.visits, self.cells)
        r, s = np.nonzero(np.outer(np.arange(first.shape[1]) + 1, np.arange(second.shape[1]) + 1) <= wanted)
        by_first, by_second = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        total = (np.take_along_axis(first, by_first, 1)[:, r] + np.take_along_axis(second, by_second, 1)[:, s])
        order = np.argsort(total, 1, kind="stable")[:, :wanted]
        return (by_first[:, r] * second.shape[1] + by_second[:, s])[np.arange(len(unit))[:, None], order]


def unit_vectors(vectors: list) -> np.ndarray:
    wide = np.array(vectors, np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # squares of very small or large numbers stay finite
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows of the sample; a codeword that loses all its points stays where it is."""
    words = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((words**2).sum(1) - 2 * points @ words.T).argmin(1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def _levels(cells: int) -> np.ndarray:
    """Numbers of visited cells that are told apart: powers of the root of 2, and all cells."""
    powers = np.unique(np.ceil(2 ** (np.arange(2 * math.log2(cells) + 1) / 2)).astype(int))
    return np.append(powers[powers < cells], cells)


def _reach(index: MultiIndex, queries: np.ndarray) -> np.ndarray:
    """Distance of the last cell that each query visits, for each of ``_levels``."""
    out = np.empty((len(queries), len(levels := _levels(index.cells))))
    for i, (first, second) in enumerate(zip(*index.distances(queries))):
        out[i] = np.sort((first[:, None] + second).ravel())[levels - 1]
    out[:, -1] = np.inf
    return out


def _places(index: MultiIndex, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many cells each query visits before it meets the home of its other vector."""
    home = index.home(others)
    out = np.empty(len(queries), np.int64)
    for i, (first, second) in enumerate(zip(*index.distances(queries))):
        r, s = divmod(int(home[i]), len(second))
        out[i] = np.searchsorted(np.sort(second), first[r] + second[s] - first, "right").sum()
    return np.maximum(out, 1)


def candidates(sample: np.ndarray, rows: int) -> list[MultiIndex]:
    """Indexes for ``rows`` vectors, from many cells down to one, with the visits that moved copies need."""
    k = max(1, min(CODEWORDS, len(sample) // 4, 1 << math.ceil(math.log2(max(1.0, math.sqrt(rows / PER_CELL))))))
    middle = sample.shape[1] // 2
    # copies at the threshold: the way to a vector across is of random direction
    unit = sample[np.linspace(0, len(sample) - 1, min(len(sample), 1024)).astype(int)]
    across = np.random.default_rng(20240502).normal(size=unit.shape)
    across -= (across * unit).sum(1, keepdims=True) * unit
    size = np.linalg.norm(across, axis=1, keepdims=True)
    moved = SIMILARITY * unit + math.sqrt(1 - SIMILARITY**2) * across / np.where(size > 1e-9, size, 1)
    out = []
    while k > 1:
        index = MultiIndex((_codebook(sample[:, :middle], k), _codebook(sample[:, middle:], k)), 1)
        # every vector queries, so either may find the other
        places = np.sort(np.minimum(_places(index, unit, moved), _places(index, moved, unit)))
        out.append(MultiIndex(index.halves, int(places[math.ceil(TARGET_RECALL * len(places)) - 1])))
        k //= 2
    return [*out, MultiIndex((sample[:1, :middle], sample[:1, middle:]), 1)]


@dataclass(frozen=True)
class QueryLinks:
    """Counts a block's links of each query: rows (index, query, level that reaches them, links)."""

    indexes: list[MultiIndex]
    queries: np.ndarray
    reach: list[np.ndarray]

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        cosine = self.queries @ unit.T
        q, x = np.nonzero((cosine >= SIMILARITY) & (cosine < 1 - 1e-12))  # the query itself says nothing
        out = [np.zeros((0, 4), np.int64)]
        for i, index in enumerate(self.indexes if len(q) else []):
            home = index.home(unit)
            first, second = index.distances(self.queries)
            away = (first[:, home // len(index.halves[1])] + second[:, home % len(index.halves[1])])[q, x]
            level = (self.reach[i][q] < away[:, None] - 1e-12).sum(1)
            each, links = np.unique(np.stack([q, level], 1), axis=0, return_counts=True)
            out.append(np.column_stack([np.full(len(each), i), each, links]))
        return np.concatenate(out)


def fit(sample: np.ndarray, rows: int, shares: Callable[[QueryLinks], list[tuple]] | None = None) -> MultiIndex:
    """An index for ``rows`` vectors from a sample of unit vectors.

    ``shares`` takes the ``QueryLinks`` and returns (index, level, sum of the queries' shares of links
    at the level) over all rows; without it the sample stands for all rows.
    """
    indexes = candidates(sample, rows)
    queries = sample[np.linspace(0, len(sample) - 1, min(len(sample), QUERIES)).astype(int)]
    count = QueryLinks(indexes, queries, [_reach(x, queries) for x in indexes])
    found = np.zeros((len(indexes), max(len(_levels(x.cells)) for x in indexes)))
    if shares:
        for i, level, share in shares(count):
            found[i, level] += share
    else:
        counted = count(sample)
        links = np.bincount(counted[counted[:, 0] == 0][:, 1], counted[counted[:, 0] == 0][:, 3], len(queries))
        np.add.at(found, (counted[:, 0], counted[:, 2]), counted[:, 3] / links[counted[:, 1]])
    fitted = []
    for index, share in zip(indexes, found):
        reached = np.cumsum(share) >= TARGET_RECALL * share.sum()
        fitted.append(MultiIndex(index.halves, max(index.visits, int(_levels(index.cells)[reached.argmax()]))))
    return min(fitted, key=lambda x: x.visits * (SENT + rows / x.cells))


def _usable(vector: Column) -> Column:
    """Neither null nor zero, without a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of the vectors in the last column, the rows that have it, and their unit vectors."""
    column = batch.column(batch.num_columns - 1)
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield d, rows, unit_vectors(flat.reshape(len(rows), d))


def _placed(vectors: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """``cell, at_home, id, copies, home, visited, vector``: each vector at home, where it lists the cells that it
    visits, and in every one of those."""
    sent = vectors.sparkSession.sparkContext.broadcast(indexes)  # LENGTHS times two codebooks of CODEWORDS rows at most
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, unit in _lengths(batch) if len(batch) else ():
                index = sent.value.get(d)
                # a few thousand rows at a time, however many cells are visited
                step = max(1, 8192 // (index.visits if index else 1))
                for at in range(0, len(rows), step):
                    own = rows[at : at + step]
                    cells = index.traverse(unit[at : at + step]) if index else np.zeros((len(own), 1), np.int64)
                    cells, v = cells + d * WIDE, cells.shape[1]
                    visits = [pa.array(np.repeat(own, v)), pa.array(cells.ravel()), pa.array(np.repeat(cells[:, 0], v))]
                    homes = [pa.array(own), pa.array(cells[:, 0]), pa.array(cells[:, 0])]
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * v, pa.int32()), pa.array(cells.ravel()))
                    for (which, cell, home), seen in ((homes, listed), (visits, pa.nulls(len(own) * v, pa.list_(pa.int64())))):
                        yield pa.RecordBatch.from_arrays(
                            [cell, pa.array(np.full(len(cell), seen is listed)), batch.column(0).take(which), batch.column(1).take(which),
                             home, seen, batch.column(2).take(which)],
                            ["cell", "at_home", "id", "copies", "home", "visited", "vector"])

    return vectors.select("id", "copies", "vector").mapInArrow(
        run, f"cell long, at_home boolean, id long, copies long, home long, visited array<long>, vector {kind}")


def _shares(vectors: DataFrame, count: QueryLinks) -> list[tuple]:
    """For ``fit``: the sampled queries against all vectors of their length; a few rows for each index reach the driver."""
    sent = vectors.sparkSession.sparkContext.broadcast(count)  # codebooks and QUERIES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                counted = sent.value(unit_vectors(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counted.T], ["i", "q", "level", "links"])

    each = vectors.select("vector").mapInArrow(run, "i long, q long, level long, links long")
    each = materialize(each.groupBy("i", "q", "level").agg(F.sum("links").alias("links")), "query-links")
    # each query weighs the same, whatever the size of its cluster
    total = each.groupBy("i", "q").agg(F.sum("links").alias("total"))
    share = each.join(fresh_keys(total, ["i", "q"]), ["i", "q"]).groupBy("i", "level").agg(
        F.sum(F.col("links") / F.col("total")).alias("share"))
    return [tuple(r) for r in share.collect()]


def _blocks(placed: DataFrame) -> DataFrame:
    """``cell, at_home, rows``: the vectors at home in a cell, and those that visit it, in blocks of about ``BLOCK``."""
    side = ["cell", "at_home"]
    counts = placed.groupBy(*side).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    # full cells only: at most CODEWORDS * CODEWORDS for each of LENGTHS lengths, and one for any other length; a shuffle
    # by cell would bring all of a hot one to one task
    dealt = placed.join(F.broadcast(counts.where("_blocks > 1")), side, "left")
    block = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).alias("block")
    return dealt.select(*side, block, "id", "copies", "home", "visited", "vector").groupBy(*side, "block").agg(
        F.collect_list(F.struct("id", "copies", "home", "visited", "vector")).alias("rows"))


def _met(left: pa.ListScalar, right: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block at home and a visiting block find: vectors with links, one of their group, and how many links each has.

    Two vectors may meet in the homes of both. The pair belongs to the lesser home, if the vector that lives there is
    met there by the other, as well as the other way round.
    """
    (ids, copies, units), (o_ids, o_copies, o_units) = [_matrix(side) for side in (left, right)]
    home, o_home = [side.values.field("home").to_numpy() for side in (left, right)]
    visited = left.values.field("visited").flatten().to_numpy().reshape(len(ids), -1)
    q, x = np.nonzero(units @ o_units.T >= SIMILARITY)
    same, returned = home[q] == o_home[x], (visited[q] == o_home[x][:, None]).any(axis=1)
    own = np.where(same, ids[q] < o_ids[x], ~returned | (home[q] < o_home[x]))
    q, x = q[own], x[own]
    # a vector of both blocks counts once
    every = np.unique(np.append(ids[q], o_ids[x]))
    a, b = np.searchsorted(every, ids[q]), np.searchsorted(every, o_ids[x])
    links = np.bincount(a, o_copies[x], len(every)) + np.bincount(b, copies[q], len(every))
    root = np.arange(len(every))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return every, every[root], links.astype(np.int64)
        root = after


def _linked(meetings: DataFrame) -> DataFrame:
    """``a, b, links``: a row for each vector with links in a meeting, one of the group it belongs to there, and the
    number of vectors linked with it there; a pair counts in one meeting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _met(left, right)], ["a", "b", "links"])

    return meetings.mapInArrow(run, "a long, b long, links long")


def _matrix(side: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = side.values
    flat = rows.field("vector").flatten().to_numpy(zero_copy_only=False)
    ids = rows.field("id").to_numpy()
    return ids, rows.field("copies").to_numpy(), unit_vectors(flat.reshape(len(ids), -1))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Links are pairs with a cosine of ``SIMILARITY`` or more, computed in double precision from the vectors as
    they are; none below is linked, and nearly all above are found (``TARGET_RECALL``). ``n_links`` counts the
    other vectors linked directly, ``component_id`` is the least id reachable, ``kept`` where that is the own id.
    Equal vectors are compared once and always linked.

    Vectors that are null, zero or hold a null or non-finite component link with nothing. Vectors of different
    lengths have no cosine; those of each length are compared with each other. Rows with a null id are left out; a repeated id is a vector for each row, all reported under the id.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    # single precision travels as it is; the cosine is computed in double
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull())
    usable = rows.where(_usable(F.col("vector")))
    # equal vectors hash alike and are told apart by their components; a hot one is one row per task
    distinct = usable.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # numbered once, when written: an id of several vectors cannot tell them apart
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    # an index for each of the lengths that many vectors have, LENGTHS at most; brute force for the rest
    lengths = distinct.groupBy(F.size("vector").alias("d")).count().where(F.col("count") >= LARGE)
    indexes = {}
    for r in lengths.orderBy(F.desc("count"), "d").limit(LENGTHS).collect():
        alike = distinct.where(F.size("vector") == r["d"])
        sample = alike.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
        indexes[r["d"]] = fit(unit_vectors([x["vector"] for x in sample]), r["count"], lambda count, alike=alike: _shares(alike, count))
    # the stage that places the vectors is not run again for the counts
    blocks = _blocks(materialize(_placed(distinct, indexes), "placed"))
    met = blocks.where("at_home").select("cell", F.col("rows").alias("left")).join(
        fresh_keys(blocks.where("NOT at_home").select("cell", F.col("rows").alias("right")), ["cell"]), "cell")
    links = materialize(_linked(met.select("left", "right")), "vector-links")
    degree = links.groupBy("a").agg(F.sum("links").alias("others"))
    links = links.where("a <> b").select("a", "b")
    roots = components(links).withColumnsRenamed({"node": "id", "component": "root"})
    members = materialize(distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    found = (
        members.join(fresh_keys(least, ["root"]), "root")
        .join(degree.withColumnRenamed("a", "id"), "id", "left")
        .select("vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    found = materialize(found, "vector-classes")
    return rows.join(found, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))

