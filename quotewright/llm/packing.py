"""Pack token sequences of any length into windows of a fixed capacity by minimum bin slack.

Documents longer than a window are cut into whole windows and a remainder. All that the plan needs is how many
pieces of each length there are: at most ``capacity`` numbers, however large the corpus. Each step fixes the
longest length left, finds by subset-sum over bitsets the multiset of remaining lengths that leaves the least
slack beside it, traces the counts back, and repeats that pattern as often as the counts allow. Every step uses
up a length or nearly so, which bounds the plan by the capacity as well.

The pieces of a length are then numbered across the cluster and look their window up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_position
from ..session import materialize
from .common import prepare
from .hf import FileTokenizer, send

PLAN = "length int, first long, last long, per_sequence int, sequence long, offset int"


def slack(total: int, capacity: int) -> int:
    """Padding of a sequence: none at a power of two, else up to the capacity."""
    return 0 if total & (total - 1) == 0 else capacity - total


def _fill(length: int, counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths beside ``length`` with the least slack, from ``counts`` (``length`` already taken)."""
    room = capacity - length
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= room), reverse=True):
        stages.append((size, reach))
        left, step = min(counts[size], room // size), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * size)) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    sums = [s for s in range(room, -1, -1) if reach >> s & 1]
    rest = min(sums, key=lambda s: (slack(length + s, capacity), -s))
    chosen: dict[int, int] = {}
    for size, before in reversed(stages):
        while not before >> rest & 1:
            chosen[size] = chosen.get(size, 0) + 1
            rest -= size
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN``: pieces ``first <= n < last`` of a length lie ``per_sequence`` to a sequence.

    Piece ``n`` goes to sequence ``sequence + (n - first) / per_sequence``, at ``offset`` and one length
    further for each piece of the same length before it there.
    """
    counts = {size: n for size, n in histogram.items() if n}
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = _fill(longest, counts, capacity)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[size] // k for size, k in pattern.items())
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            rows.append((size, used[size], used[size] + times * k, k, sequence, offset))
            used[size] += times * k
            counts[size] -= times * k
            offset += size * k
            if not counts[size]:
                del counts[size]
        sequence += times
    return rows


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (packed): each text's ids, cut.

    A null text counts as empty: its only id is ``end_id``. Repeated rows are pieces of their own.
    """
    spark = prepare(docs.sparkSession)
    content = send(spark, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = FileTokenizer.of(content.value)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            owner, start, length, crc, total, pieces = [], [], [], [], [], []
            for row, ids in enumerate(tokenizer.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    owner.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        pieces.append(piece)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()),
                       pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(pieces, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    Offsets are gapless from 0 in each sequence. Pieces of one length are served in ``order``; rows equal in it
    are interchangeable. ``pieces`` should be a written table: it is read more than once.
    """
    spark = pieces.sparkSession
    # at most `capacity` rows, whatever the number of pieces
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for size in sorted(histogram):
        before[size] = at
        at += histogram[size]
    rows = [(size, before[size] + first, before[size] + last, *rest)
            for size, first, last, *rest in plan_windows(histogram, capacity)]
    # a few rows for each length
    plan = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "_length"))
    placed = with_position(pieces, ["length", *order], "_n")
    here = (F.col("length") == F.col("_length")) & (F.col("_n") >= F.col("first")) & (F.col("_n") < F.col("last"))
    nth = F.col("_n") - F.col("first")
    return placed.join(plan, here).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Tokenize, cut and pack whole documents; columns of ``tokenize_pieces``, ``sequence_id`` and ``offset``.

    An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    cut = tokenize_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids)
    packed = pack(materialize(cut, "pieces"), capacity)
    return packed.withColumn("length", F.col("length").cast("long"))
