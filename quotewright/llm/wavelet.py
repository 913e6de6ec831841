"""Token ids in wavelet-matrix files: one compressed structure for access, counting and occurrence lookup.

A shard holds the ids of whole documents in ascending document order. Its distinct ids are numbered densely in
ascending order; the numbers are split into bit-planes, highest bit first, and each plane orders the ids by the
bits seen so far (zeros before ones, otherwise in order). Rank and select on the planes answer everything:
``access`` (the id at a place), ``rank`` (how often an id occurs before a place), ``select`` (where it occurs
the k-th time). A file holds the planes as bits and one running count for every ``BLOCK`` of them.

Spark writes the shards as rows of Parquet files and reads them back, so that a lost task is simply run again
and any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare
from .hf import FileTokenizer, send

#: Bits between two stored running counts.
BLOCK = 512
#: A shard ends with the document that takes it to so many ids.
SHARD_TOKENS = 1 << 19

SHARD = (
    "part int, shard int, start_in_part long, n_tokens long, doc_ids array<{id}>, doc_tokens array<long>, "
    "alphabet binary, zeros array<long>, planes binary, counts binary"
)


class WaveletMatrix:
    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: np.ndarray, counts: np.ndarray) -> None:
        """``planes``: one row of packed bits per level, low bit first; ``counts``: ones before each block."""
        self.n, self.alphabet, self.zeros, self.planes, self.counts = n, alphabet, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet, dense = _dense(ids)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        row = dense.astype(np.uint16 if levels <= 16 else np.uint32)
        blocks = -(-len(ids) // BLOCK)
        planes = np.zeros((levels, blocks * BLOCK // 8), np.uint8)
        zeros = []
        for level in range(levels):
            ones = (row >> (levels - 1 - level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes[level, : len(packed)] = packed
            low = row[~ones]
            zeros.append(len(low))
            row = np.concatenate([low, row[ones]])
        per_block = np.bitwise_count(planes).reshape(levels, blocks, BLOCK // 8).sum(axis=2, dtype=np.uint32)
        counts = np.cumsum(per_block, axis=1, dtype=np.uint32) - per_block
        return cls(len(ids), alphabet, zeros, planes, counts)

    @property
    def levels(self) -> int:
        return len(self.zeros)

    def _ones_before(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place, from the block's running count and the bits inside the block."""
        plane, counts = self.planes[level], self.counts[level]
        block = np.minimum(places // BLOCK, max(0, len(counts) - 1))
        out = counts[block].astype(np.int64)
        for one, (place, at) in enumerate(zip(places.tolist(), block.tolist())):
            bits = np.unpackbits(plane[at * BLOCK // 8 : -(-place // 8)], bitorder="little")
            out[one] += int(bits[: place - at * BLOCK].sum())
        return out

    def _bit(self, level: int, places: np.ndarray) -> np.ndarray:
        return self.planes[level][places >> 3] >> (places & 7).astype(np.uint8) & 1

    def access(self, places) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(places, np.int64)
        dense = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = self._bit(level, at).astype(bool)
            ones = self._ones_before(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            dense = dense << 1 | bit
        return self.alphabet[dense]

    def _symbol(self, token: int) -> int | None:
        found = int(np.searchsorted(self.alphabet, token))
        return found if found < len(self.alphabet) and self.alphabet[found] == token else None

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences before ``end`` lie behind the last plane."""
        low, high = np.array([0]), np.array([end])
        for level in range(self.levels):
            a, b = self._ones_before(level, low), self._ones_before(level, high)
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return int(low[0]), int(high[0])

    def rank(self, token: int, end: int | None = None) -> int:
        """How often a token occurs before ``end`` (anywhere by default)."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        low, high = self._range(symbol, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int | None:
        """Place of the k-th occurrence, counted from 0; None if there are not so many."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.rank(token):
            return None
        at = self._range(symbol, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] * bit)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th zero or one of a plane."""
        ones = self.counts[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            upper = np.empty(self.n, kind)
            upper[~ones] = row[: self.zeros[level]]
            upper[ones] = row[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            row = upper
        return self.alphabet[row] if self.n else np.zeros(0, np.uint32)

    def columns(self) -> dict[str, object]:
        return {"alphabet": self.alphabet.astype("<u4").tobytes(), "zeros": self.zeros,
                "planes": self.planes.tobytes(), "counts": self.counts.astype("<u4").tobytes()}

    @classmethod
    def of(cls, row: dict) -> WaveletMatrix:
        """A matrix from a row of a shard file."""
        levels = len(row["zeros"])
        planes = np.frombuffer(row["planes"], np.uint8).reshape(levels, -1) if levels else np.zeros((0, 0), np.uint8)
        counts = np.frombuffer(row["counts"], "<u4").reshape(levels, -1) if levels else np.zeros((0, 0), np.uint32)
        return cls(row["n_tokens"], np.frombuffer(row["alphabet"], "<u4"), list(row["zeros"]), planes, counts)


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and each id's number among them."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    present = np.zeros(int(ids.max()) + 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    number = np.zeros(len(present), np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    return alphabet, number[ids]


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode whole texts and write the shard files; ``end_id`` follows each document.

    Parts are ranges of ascending ids (a null id comes first, repeated ids lie together in the order of their
    texts), shards are numbered in a part. A null text counts as empty; an empty table has no shard. A document
    is never split over shards.
    """
    spark = prepare(docs.sparkSession)
    content = send(spark, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = FileTokenizer.of(content.value)
        end, part = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        shard, start, held, owners = 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, start, held, owners
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "shard": shard, "start_in_part": start, "n_tokens": len(ids),
                   "doc_ids": owners, "doc_tokens": [len(x) // 4 for x in held]} | WaveletMatrix.build(ids).columns()
            shard, start, held, owners = shard + 1, start + len(ids), [], []
            return pa.RecordBatch.from_pylist([row], arrow_schema)

        size = 0
        for batch in batches:
            for owner, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist())):
                owners.append(owner)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= SHARD_TOKENS:
                    size = 0
                    yield close()
        if held:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow_schema = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("alphabet", pa.binary()),
        ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()), ("counts", pa.binary()),
    ])
    (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
        .repartitionByRange(parts, "_id")
        .sortWithinPartitions("_id", "_text")
        .mapInArrow(run, SHARD.format(id="bigint"))
        .write.parquet(path)
    )


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shard files, from their bits alone.

    ``start`` is the number of ids in all documents before it; ``ids_crc32`` is the unsigned CRC-32 of the ids
    as little-endian unsigned 32-bit integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.of(row).all().astype("<u4").tobytes()
                ends = np.cumsum([0, *row["doc_tokens"]])
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()),
                    pa.array(row["start_in_part"] + ends[:-1], pa.int64()), pa.array(row["doc_tokens"], pa.int64()),
                    pa.array(crc, pa.int64()),
                ], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    # one row per part, so the window and the broadcast are over as many rows as there were tasks
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    docs = shards.mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the shard files below ``path`` (a new scratch folder by default) and read every document back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    write_shards(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read_documents(spark.read.schema(SHARD.format(id="bigint")).parquet(path))
