"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is a sequence of shingles of five words, each labelled with its occurrence so that a repeated shingle
counts as often as it stands there. A sketch takes the few labelled shingles with the smallest hashes and keeps
them in text order, so that two texts agree in it when they share shingles *and* have them in the same order.
Texts that agree in one of the sketches are candidates; the alignment decides: the longest sequence of common
labelled shingles in the order of both texts, within the band that the threshold leaves, as a part of all
shingles. It is the Jaccard similarity of the shingles, counted in order.

Candidates of a large bucket (a thousand copies of one text, a passage in a third of all texts) are compared all
with each other too, but not as pairs of rows: the bucket is cut into blocks of bounded size, and where two blocks
meet, the common shingles of all their pairs are counted at once. Pairs with enough of them are aligned. A meeting
returns the number of links of each text and a forest of the links, so what it returns does not grow with the
square of the bucket.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.joins import fresh_keys
from ..session import materialize
from .common import prepare
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Sketches of a text and shingles in each. Two texts at the threshold agree in one sketch with about
#: ``SIMILARITY ** TAKEN``, so that one pair in 100,000 agrees in none.
SKETCHES, TAKEN = 16, 3
#: Up to so many different texts of a bucket are compared by pairs of rows, more of them by blocks.
SMALL = 12
#: Texts and shingles of a block, on average at most, and different shingles that are counted at once.
BLOCK, BLOCK_SHINGLES, COUNTED = 256, 1 << 17, 4096

_ONE = np.ones(1, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for texts of up to n bytes."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([_ONE, np.full(size - 1, x, np.uint64)]), dtype=np.uint64)
                      for x in (_BASE, _INVERSE)]
    return _powers


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the labelled shingles of a text in text order; one for fewer words than a shingle, none for no word.

    Words are runs of letters and digits in lower case.
    """
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    inside = np.concatenate([[False], _WORD_BYTE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    # hash of a word: its bytes weighted by powers of the base, wherever it stands
    weighed = np.cumsum((raw.astype(np.uint64) + _ONE) * power[: len(raw)], dtype=np.uint64)
    sums = np.concatenate([_ONE - _ONE, weighed])
    word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    n = len(word) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD + word[j : j + n]
    h = _mix(h)
    # occurrence label: place within the run of equal hashes
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return h
    run = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    label = np.zeros(n, np.uint64)
    label[order] = run.astype(np.uint64)
    return np.where(label > 0, _mix(h + label * _ODD), h)


def _seeds(sketches: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, (2, sketches), dtype=np.uint64) | np.uint64(1)


def sketch(h: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """One key for each sketch: its smallest labelled shingles, in text order."""
    multiply, add = _seeds(sketches)
    ranks = _mix(h[None, :] * multiply[:, None] + add[:, None])
    if len(h) > taken:
        least = np.argpartition(ranks, taken - 1, axis=1)[:, :taken]
        least.sort(axis=1)  # text order
    else:
        least = np.broadcast_to(np.arange(len(h)), (sketches, len(h)))
    key = np.arange(1, sketches + 1).astype(np.uint64) * _ODD
    for place in range(least.shape[1]):
        key = _mix(key * _ODD + h[least[:, place]])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY, order: np.ndarray | None = None) -> float:
    """Common labelled shingles in the order of both texts, as a part of all; 0.0 once it must be below ``threshold``.

    ``order`` sorts ``b``, where that is known already.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    band = total * (1 - threshold) / (1 + threshold)
    order = np.argsort(b) if order is None else order
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    there = order[at]
    own = np.flatnonzero((b[there] == a) & (np.abs(there - np.arange(len(a))) <= band))
    places = there[own]
    if len(places) * (1 + threshold) < threshold * total - 1e-9:
        return 0.0
    chain = len(places)
    if (np.diff(places) <= 0).any():
        ends: list[int] = []
        for place in places.tolist():
            found = bisect_left(ends, place)
            ends[found : found + 1] = [place]
        chain = len(ends)
    return chain / (total - chain)


def sketch_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, same, n, keys``: digest of the text, number of shingles and sketch keys of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text)
                sizes.append(len(h))
                keys.append(sketch(h) if len(h) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "same", "n", "keys"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("same"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, same string, n int, keys array<long>")


def _buckets(texts: DataFrame) -> DataFrame:
    """``key, place, doc_id, same, n, blocks``: the buckets of two texts or more; ``blocks`` is 0 for a small one."""
    rows = texts.select(F.posexplode("keys").alias("place", "key"), "doc_id", "same", "n")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where(F.col("size") > 1)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    counts = counts.select("key", F.when(F.col("size") > SMALL, blocks).otherwise(0).cast("int").alias("blocks"))
    return materialize(rows.join(fresh_keys(counts, ["key"]), "key"), "buckets")


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of small buckets to compare."""
    small = buckets.where(F.col("blocks") == 0).select("key", "doc_id", "n")
    # at most SMALL rows of a key on either side
    other = fresh_keys(small, ["key"]).select("key", F.col("doc_id").alias("o_id"), F.col("n").alias("o_n"))
    pairs = small.join(other, "key").where(F.col("doc_id") < F.col("o_id"))
    alike = F.least("n", "o_n") >= SIMILARITY * F.greatest("n", "o_n")  # else no alignment can do
    return pairs.where(alike).select(F.col("doc_id").alias("a"), F.col("o_id").alias("b")).distinct()


def _blocks(buckets: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, block, rows``: large buckets in blocks of (doc_id, h, keys, large).

    ``h`` holds the text's shingles; ``keys`` its key in each sketch, 0 where it has no company, and ``large``
    a bit for each sketch whose bucket is large.
    """
    held = buckets.groupBy("doc_id", "same").agg(F.collect_list(F.struct("place", "key", "blocks")).alias("held"))
    held = held.where(F.exists("held", lambda x: x["blocks"] > 0))
    texts = rows.select("doc_id", F.sha2("text", 256).alias("same"), "text")
    # a repeated row counts once
    members = texts.join(fresh_keys(held, ["doc_id", "same"]).hint("merge"), ["doc_id", "same"])
    members = members.groupBy("doc_id", "same").agg(F.first("text").alias("text"), F.first("held").alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(text).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(h, pa.binary())],
                ["doc_id", "same", "held", "h"])

    kinds = dict(members.dtypes)
    cut = members.select("doc_id", "same", "text", "held").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, same string, held {kinds['held']}, h binary")
    by_place = F.map_from_arrays(F.transform("held", lambda x: x["place"]), F.transform("held", lambda x: x["key"]))
    keys = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: F.coalesce(F.element_at(by_place, i), F.lit(0)))
    large = F.aggregate("held", F.lit(0), lambda bits, x: bits + F.when(
        x["blocks"] > 0, F.call_function("shiftleft", F.lit(1), x["place"])).otherwise(0))
    each = cut.select("doc_id", "same", "h", keys.alias("keys"), large.alias("large"), F.explode("held").alias("at"))
    each = each.where(F.col("at.blocks") > 0)
    block = F.pmod(F.xxhash64("same"), F.col("at.blocks")).alias("block")
    return each.select(F.col("at.key").alias("key"), block, "doc_id", "h", "keys", "large").groupBy("key", "block").agg(
        F.collect_list(F.struct("doc_id", "h", "keys", "large")).alias("rows"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common labelled shingles of each text of ``a`` with each of ``b``."""
    flat = [np.concatenate(side) for side in (a, b)]
    text = [np.repeat(np.arange(len(side)), [len(h) for h in side]) for side in (a, b)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    column = [np.minimum(np.searchsorted(shared, f), len(shared) - 1) for f in flat]
    found = [shared[c] == f for c, f in zip(column, flat)]
    text, column = [t[k] for t, k in zip(text, found)], [c[k] for c, k in zip(column, found)]
    order = [np.argsort(c, kind="stable") for c in column]
    text, column = [t[o] for t, o in zip(text, order)], [c[o] for c, o in zip(column, order)]
    for at in range(0, len(shared), COUNTED):
        sides = []
        for t, c, n in zip(text, column, out.shape):
            low, high = np.searchsorted(c, [at, at + COUNTED])
            side = np.zeros((n, min(COUNTED, len(shared) - at)), np.float32)
            side[t[low:high], c[low:high] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _met(ids: list[np.ndarray], h: list[list[np.ndarray]], keys: list[np.ndarray], large: list[np.ndarray], key: int,
         same: bool) -> list[tuple]:
    """(a, b, 0) for the links of a forest and (a, a, number of links) of the texts of two blocks, or of one.

    A pair is compared in the first of its sketches only, and not here if a small bucket has it.
    """
    n, m = [np.array([len(x) for x in side]) for side in h]
    total = n[:, None] + m[None, :]
    enough = _common(*h) * (1 + SIMILARITY) >= SIMILARITY * total - 1e-6 * total  # else no alignment can do
    q, x = np.nonzero(np.triu(enough, 1) if same else enough)
    agreed = (keys[0][q] == keys[1][x]) & (keys[0][q] != 0)
    place = int(np.flatnonzero(keys[0][0] == key)[0])
    is_large = (large[0][q][:, None] >> np.arange(agreed.shape[1])) & 1 == 1
    own = (ids[0][q] != ids[1][x]) & ~(agreed & ~is_large).any(1) & (agreed.argmax(1) == place)
    shift = 0 if same else len(ids[0])
    parent = list(range(len(ids[0]) + (0 if same else len(ids[1]))))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    orders: dict[int, np.ndarray] = {}
    degree, out = [0] * len(parent), []
    for i, j in zip(q[own].tolist(), x[own].tolist()):
        if j not in orders:
            orders[j] = np.argsort(h[1][j])
        if similarity(h[0][i], h[1][j], order=orders[j]) >= SIMILARITY:
            degree[i] += 1
            degree[j + shift] += 1
            u, v = root(i), root(j + shift)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((*sorted((ids[0][i].item(), ids[1][j].item())), 0))
    every = ids[0].tolist() + ([] if same else ids[1].tolist())
    return out + [(i, i, d) for i, d in zip(every, degree) if d]


def _large_links(blocks: DataFrame) -> DataFrame:
    """``a, b, degree``: what ``_met`` finds where blocks of a bucket meet each other and themselves."""
    alone = blocks.select("key", F.col("rows").alias("left"), F.slice("rows", 1, 0).alias("right"))
    other = fresh_keys(blocks.select("key", F.col("block").alias("o_block"), F.col("rows").alias("right")), ["key"])
    met = blocks.withColumnRenamed("rows", "left").join(other.hint("merge"), "key").where(F.col("block") < F.col("o_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows: pa.ListScalar) -> tuple:
            values = rows.values
            texts = [np.frombuffer(x, np.uint64) for x in values.field("h").to_pylist()]
            keys = values.field("keys").flatten().to_numpy().reshape(len(texts), -1)
            return np.array(values.field("doc_id").to_pylist()), texts, keys, values.field("large").to_numpy()

        for batch in batches:
            out = []
            for key, left, right in zip(*[batch.column(i) for i in range(3)]):
                first = side(left)
                same = not len(right)
                out += _met(*[list(x) for x in zip(first, first if same else side(right))], key.as_py(), same)
            columns = list(zip(*out)) or [[], [], []]
            kinds = [kind_of, kind_of, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "degree"])

    kind = blocks.schema["rows"].dataType.elementType["doc_id"].dataType
    kind_of = to_arrow_type(kind)
    return alone.unionByName(met.select("key", "left", "right")).mapInArrow(
        run, f"a {kind.simpleString()}, b {kind.simpleString()}, degree int")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose alignment reaches the threshold: both texts of a pair meet in one task, next to each other."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")).hint("merge")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        sides.join(texts, "doc_id").select("a", "b", "doc_id", "text")
        .repartition(parts, "a", "b").sortWithinPartitions("a", "b", "doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the texts of a pair's first id come first: one, unless rows repeat the id
        first, held = None, []
        for batch in batches:
            found: dict[tuple, None] = {}
            ids = [batch.column(i).to_pylist() for i in range(3)]
            for a, b, doc_id, text in zip(*ids, batch.column(3).to_pylist()):
                if (a, b) != first:
                    first, held = (a, b), []
                if doc_id == a:
                    held.append(shingles(text))
                elif (a, b) not in found:
                    own = shingles(text)
                    if any(similarity(other, own) >= SIMILARITY for other in held):
                        found[a, b] = None
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type) for c in columns], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, component_id, kept, n_links``.

    Texts are linked at a similarity of ``SIMILARITY`` or more; ``component_id`` is the least id reachable by
    links, itself included, and the document with that id is kept. Identical texts belong together always,
    texts without a word only then. ``n_links`` counts the different texts that the text was found linked with.

    A null text counts as empty. Rows with a null id are left out: an id is what a link is made of. Repeated
    rows with one id and text count as one; an id with several texts belongs with all of them. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull())
    sketched = materialize(sketch_texts(rows), "sketches")
    first = sketched.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = materialize(first.where(F.col("n") > 0), "texts")
    buckets = _buckets(texts)
    # whole texts are shuffled once, for those in company, by the same plan at every size
    company = fresh_keys(buckets.select("doc_id").distinct(), ["doc_id"]).hint("merge")
    rows = materialize(rows.join(company, "doc_id", "left_semi"), "texts-in-company")
    links = materialize(_verified(materialize(_small_pairs(buckets), "pairs"), rows).distinct(), "links")
    # links within large buckets: a forest of them, and the number that each text has
    large = materialize(_large_links(materialize(_blocks(buckets, rows), "blocks")), "links-of-large-buckets")
    copies = sketched.join(fresh_keys(first.select("same", F.col("doc_id").alias("first")), ["same"]), "same")
    copies = materialize(copies.select("doc_id", "first").distinct(), "copies")
    joined = links.unionByName(large.where("a != b").select("a", "b")).unionByName(
        copies.where(F.col("doc_id") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    classes = components(joined).withColumnsRenamed({"node": "doc_id"})
    ends = links.select(F.explode(F.array("a", "b")).alias("first"), F.lit(1).alias("degree"))
    degree = ends.unionByName(large.where("a = b").select(F.col("a").alias("first"), "degree")).groupBy("first").agg(
        F.sum("degree").alias("n_links"))
    each = copies.join(fresh_keys(degree, ["first"]), "first", "left").groupBy("doc_id").agg(
        F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return each.join(classes, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"), "n_links")
