"""Byte-level BPE with the tiktoken library and a local rank file: encode texts to ids, decode ids to bytes.

Texts are cut at safe boundaries first (``parts``), so that none is too long for the library's split pattern.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .parts import PartEncoder, as_bytes

#: A part longer than this has no safe boundary inside; it is cut where the split pattern itself ends a match.
LONG_PART = 50_000

_codecs: dict[tuple[bytes, str], Codec] = {}


class Codec:
    """One rank file and split pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.parts = PartEncoder(lambda parts: [as_bytes(self._ids(part)) for part in parts])

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = hashlib.sha256(ranks).digest(), pattern
        if key not in _codecs:
            _codecs[key] = cls(ranks, pattern)
        return _codecs[key]

    def _ids(self, part: str) -> list[int]:
        if len(part) > LONG_PART:
            # each match by itself: the library's own pattern engine may give up on so long a run
            return [i for match in self.pattern.findall(part) for i in self.encoding._encode_single_piece(match)]
        return self.encoding.encode_ordinary(part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.parts.encode(texts)

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)


def _ids_column(chunks: list[bytes]) -> pa.Array:
    offsets, end = [0], 0
    for chunk in chunks:
        end += len(chunk) // 4
        offsets.append(end)
    flat = pa.Array.from_buffers(pa.int32(), end, [None, pa.py_buffer(b"".join(chunks))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int): the ids of each text, special tokens being ordinary text.

    A null text counts as empty and has no ids. One row per input row, repeated rows included; null ids
    pass through; other columns are ignored. The rank file is read where the driver runs and travels along.
    """
    ranks = _read(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for batch in batches:
            chunks = codec.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_column(chunks)], ["doc_id", "ids"])

    return _pair(docs, id_col, text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` (binary): the bytes behind each row's ids; null ids give empty bytes.

    Bytes, not text: ids cut from a longer sequence need not be whole characters.
    """
    ranks = _read(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for batch in batches:
            texts = pa.array([codec.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return _pair(encoded, id_col, ids_col).mapInArrow(run, f"doc_id {_kind(encoded, id_col)}, decoded binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode and decode in one pass; digests of both instead of the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers. Rows as in ``encode``.
    """
    ranks = _read(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for batch in batches:
            lengths, ids_sha, text_sha = [], [], []
            for ids in codec.encode(batch.column(1).to_pylist()):
                lengths.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = f"doc_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _pair(docs, id_col, text_col).mapInArrow(run, kind)


def _read(df: DataFrame, ranks_path: str):
    prepare(df.sparkSession)
    with open(ranks_path, "rb") as file:  # below 1 MB: a vocabulary, not data
        return df.sparkSession.sparkContext.broadcast(file.read())


def _pair(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.select(F.col(first).alias("_first"), F.col(second).alias("_second"))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
