"""Alignment of the tokens that two tokenizers make of the same texts.

Both cut the same bytes, a space and the text. Places where a token of either ends divide the bytes into groups;
the tokens of one group are linked with each other. How many documents link two ids tells which id of the other
vocabulary stands for an id.

Spans come from the libraries: character offsets of the first tokenizer, and of the second one the spans of its
proto, as the offset mapping that the library derives from it (its immutable proto is no longer offered).
They are coarse where several tokens share a character (its bytes, or byte-fallback tokens): such a run of tokens
is divided by the lengths of their decoded bytes.

No token of either crosses the place before a space that follows other characters (``parts``), and both end there,
so texts are aligned word by word, and a worker remembers the words it has seen. Links are counted in two steps:
ids linked by many documents are few, and their counts, at most ``FREQUENT`` of them, are broadcast; the others are
joined. Nothing else depends on the size of the vocabularies.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import materialize
from .common import prepare
from .hf import _VISIBLE, send
from .parts import CHARS, cut

#: Pairs of ids whose counts are broadcast, at most.
FREQUENT = 1 << 18

#: Words that a worker remembers beyond one batch, at most, and those that it encodes together.
MOST, JOINED = 500_000, 1024
#: Links of a group from which equal ids are counted, not listed.
MANY = 256
#: The two ids of a pair in one number.
SHIFT = 32


class Rows:
    """Rows of numbers to which more are added, and taken off again, at the end."""

    def __init__(self, columns: int) -> None:
        self.size, self._held = 0, np.zeros((1024, columns), np.int64)

    @property
    def held(self) -> np.ndarray:
        return self._held[: self.size]

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self._held):
            self._held = np.concatenate([self.held, np.zeros((max(need, 2 * self.size) - self.size, self._held.shape[1]), np.int64)])
        self._held[self.size : need] = more
        self.size = need


def ends_of(lengths: np.ndarray, spans: np.ndarray, byte_at: np.ndarray | None) -> np.ndarray:
    """Where tokens end, in bytes, from their spans in characters and the lengths of their decoded bytes.

    A span that ends behind the one before it, and where the next one starts, ends a token there. Between such
    places, which is where tokens share a character, the decoded lengths divide the bytes. ``byte_at`` gives the byte
    where a character starts, if some have several bytes.
    """
    start, end = spans[:, 0], spans[:, 1]
    clear = np.append(start[1:] >= end[:-1], True)
    clear &= end > np.append(0, end[:-1])
    coarse = end if byte_at is None else byte_at[end]
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(clear, np.arange(len(end)), -1))
    return total + np.where(last >= 0, coarse[last] - total[last], 0)


def _spans(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class PairAligner:
    """Both tokenizers, and what they made of the words seen so far."""

    def __init__(self, spec: bytes, model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        hidden = {chr(shown): byte for byte, shown in _VISIBLE.items()}
        as_byte = {chr(byte): byte for byte in range(256) if byte not in _VISIBLE} | hidden
        names = {number: name for name, number in json.loads(spec)["model"]["vocab"].items()}
        plain = {number: bytes(as_byte[c] for c in name) for number, name in names.items() if as_byte.keys() >= set(name)}
        self.bytes_a = [plain.get(number, b"") for number in range(max(names) + 1)]
        self.bytes_b = [self._piece(number) for number in range(self.b.vocab_size())]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = [str(number) + mark for number in range(most) for mark in (",", "|", ";", "")]
        # by the word without the space before it: its row in the others
        self.words: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = Rows(7)  # n_a, n_b, n_groups, n_links, odd, where its pairs start, how many there are
        self.pairs = Rows(2)  # first id times the second vocabulary's size and second id, links

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _learn(self, words: list[str]) -> None:
        """Remember words that are encoded together, with a space before each; each must end in none."""
        text = " " + " ".join(words)
        whole = text.encode()
        a = self.a.encode(text, add_special_tokens=False)
        ids_a, spans_a = np.array(a.ids, np.int64), _spans(a.offsets)
        if text == " ":
            ids_b, spans_b = np.array([self.space]), np.array([[0, 1]])
        else:
            b = self.b.encode_as_offset_mapping(text[1:])
            # the library adds the space, so spans move by one; the first token starts with it
            ids_b, spans_b = np.array(b["ids"], np.int64), _spans(b["offsets"]) + 1
            spans_b[0, 0] = 0
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        if not (b"".join(map(self.bytes_a.__getitem__, list_a)) == b"".join(map(self.bytes_b.__getitem__, list_b)) == whole):
            if len(words) > 1:
                for word in words:
                    self._learn([word])
            else:
                self._add(words, np.array([[0, 0, 0, 0, 1, self.pairs.size, 0]]), [""], np.zeros((0, 2), np.int64))
            return
        byte_at = None
        if len(whole) > len(text):  # characters of several bytes
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            byte_at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
        ends_a = ends_of(self.lengths_a[ids_a], spans_a, byte_at)
        ends_b = ends_of(self.lengths_b[ids_b], spans_b, byte_at)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        links = in_a * in_b
        # words by where they end
        word_ends = np.cumsum([len(word) + 1 for word in words])
        if byte_at is not None:
            word_ends = byte_at[word_ends]
        word = np.searchsorted(word_ends, common)
        count = lambda values: np.bincount(word, values, len(words)).astype(np.int64)
        first_b = np.cumsum(in_b) - in_b
        small = links <= MANY
        of_a = np.flatnonzero(small[group_a])
        times = in_b[group_a[of_a]]
        pair = np.repeat(ids_a[of_a], times) * len(self.bytes_b) + ids_b[_flat(first_b[group_a[of_a]], times)]
        owner = np.repeat(word[group_a[of_a]], times)
        rows = np.stack([pair, np.ones(len(pair), np.int64)], axis=1)
        for group in np.flatnonzero(~small):  # equal ids of a large group at once
            times_b = Counter(ids_b[group_b == group].tolist())
            more = [(x * len(self.bytes_b) + y, n * t) for x, n in Counter(ids_a[group_a == group].tolist()).items() for y, t in times_b.items()]
            rows, owner = np.concatenate([rows, more]), np.append(owner, np.full(len(more), word[group]))
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=len(words))
        sums = np.stack([count(in_a), count(in_b), count(None), count(links), np.zeros(len(words), np.int64),
                         self.pairs.size + np.cumsum(sizes) - sizes, sizes], axis=1)
        # ids in the order of the groups, the first tokenizer's before the second's, each with what follows it
        place = np.argsort(np.append(group_a * 2, group_b * 2 + 1), kind="stable")
        side = np.append(group_a * 2, group_b * 2 + 1)[place]
        following = np.append(side[1:], -1)
        mark = np.where(following == side, 0, np.where(following >> 1 == side >> 1, 1, 2))
        of_word = word[side >> 1]
        mark[np.append(of_word[1:] != of_word[:-1], True)] = 3
        shown = [self.shown[k] for k in (np.append(ids_a, ids_b)[place] * 4 + mark).tolist()]
        stops = np.cumsum(np.bincount(of_word, minlength=len(words))).tolist()
        listed = ["".join(shown[start:stop]) for start, stop in zip([0, *stops], stops)]
        self._add(words, sums, listed, rows[order])

    def _add(self, words: list[str], sums: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        for word in words:
            self.words[word] = len(self.words)
        self.groups += groups
        self.sums.add(sums)
        self.pairs.add(pairs)

    def _learn_all(self, new: list[str]) -> int:
        """Remember all of these; the number of words up to the last one that is worth keeping."""
        new.sort(key=lambda word: len(word) > CHARS)
        short = sum(len(word) <= CHARS for word in new)
        keep = len(self.words) + short
        for some in (new[:short], new[short:]):
            # a space behind white space is no place to cut
            joinable = [word for word in some if word and not word[-1].isspace()]
            for at in range(0, len(joinable), JOINED):
                self._learn(joinable[at : at + JOINED])
            for word in some:
                if not word or word[-1].isspace():
                    self._learn([word])
        return keep

    def _forget(self, keep: int) -> None:
        if keep < len(self.words):
            self.pairs.size = int(self.sums.held[keep, 5])
            self.sums.size = keep
            del self.groups[keep:]
            for word in list(islice(reversed(self.words), len(self.words) - keep)):
                del self.words[word]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text ``n_a, n_b, n_groups, n_links`` and its groups; then pairs of ids, their links, and how many
        pairs each text has.

        Nothing but zeros and empty texts for a text that is null or empty, or that the tokens of either do not give back.
        """
        cuts = []
        for text in texts:
            head, words = cut(text or "")
            cuts.append([head, *words] if text else [])
        before = len(self.words)
        keep = self._learn_all(list(set().union(*cuts).difference(self.words)))
        known = [list(map(self.words.__getitem__, words)) for words in cuts]
        odd = set(np.flatnonzero(self.sums.held[:, 4]).tolist())
        for at, words in enumerate(known if odd else []):
            if not odd.isdisjoint(words):
                # bytes of single words do not give the text: look at it whole
                if texts[at] not in self.words:
                    self._learn([texts[at]])
                known[at] = [self.words[texts[at]]]
        rows = np.fromiter(chain.from_iterable(known), np.int64)
        text_of = np.repeat(np.arange(len(texts)), [len(words) for words in known])
        # each word once for each text
        both, times = np.unique(text_of * max(1, len(self.words)) + rows, return_counts=True)
        text_of, rows = both // max(1, len(self.words)), both % max(1, len(self.words))
        sums = self.sums.held[rows]
        numbers = np.stack([np.bincount(text_of, sums[:, k] * times, len(texts)) for k in range(4)], axis=1).astype(np.int64)
        pair, links = self.pairs.held[_flat(sums[:, 5], sums[:, 6])].T
        links = links * np.repeat(times, sums[:, 6])
        wide = len(self.bytes_a) * len(self.bytes_b)
        key = np.repeat(text_of, sums[:, 6]) * wide + pair
        order = np.argsort(key)
        key, links = key[order], links[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key, links = key[first], np.add.reduceat(links, first) if len(first) else links
        pair = key % wide
        pair = pair // len(self.bytes_b) << SHIFT | pair % len(self.bytes_b)
        listed = [";".join(map(self.groups.__getitem__, words)) for words in known]
        found = numbers, listed, pair, links, np.bincount(key // wide, minlength=len(texts))
        self._forget(before if len(self.words) > MOST else keep)
        return found


_aligners: dict[bytes, PairAligner] = {}


def _aligner(spec: bytes, model: bytes) -> PairAligner:
    """Loaded once by each Python worker."""
    key = hashlib.sha256(spec + model).digest()
    if key not in _aligners:
        _aligners[key] = PairAligner(spec, model)
    return _aligners[key]


def align_tokens(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links``.

    ``path_a`` is a file of a byte-level tokenizer of the tokenizers library, ``path_b`` a sentencepiece model.
    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256 instead. ``pairs`` are
    the pairs of ids linked in the text (``a`` times 2^32 and ``b``), ``links`` how many token pairs each stands for.
    Null and empty texts, and texts that the tokens of either do not give back byte by byte, have no tokens: zeros,
    an empty text, undigested, and empty lists. Repeated rows and null ids are rows like others; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    spec, model = send(spark, path_a), send(spark, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(spec.value, model.value)
        for batch in batches:
            numbers, groups, pairs, links, sizes = aligner.align(batch.column(1).to_pylist())
            if digest:
                groups = [hashlib.sha256(listed.encode()).hexdigest() if listed else "" for listed in groups]
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(links))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "pairs array<long>, links array<long>")
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a, b, n, best``: how many rows of ``aligned`` link two ids, and whether none links ``a`` to another id
    more often (ties are all best)."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    counts = counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "n")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))  # one row for each id of the first vocabulary
    return lookup(counts, most, ["a"]).select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have that count or a higher one."""
    size = F.floor(F.log2("n") + 1e-9).cast("int")
    by_size = {r["size"]: r["count"] for r in counts.groupBy(size.alias("size")).count().collect()}  # 64 rows at most
    total, least = 0, max(by_size, default=0) + 1
    for size in sorted(by_size, reverse=True):
        total += by_size[size]
        if total > most:
            break
        least = size
    return 1 << least


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is ``best``) and ``count_sum`` (the sum of ``n`` over all links).

    Both tables should be written ones. Counts of frequent pairs are looked up in the tasks, those of others joined.
    """
    spark = aligned.sparkSession
    least = _least_frequent(counts, FREQUENT)
    frequent = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow().sort_by("pair")  # FREQUENT rows at most
    columns = (frequent["pair"].to_numpy(), frequent["n"].to_numpy(), frequent["best"].to_numpy())
    sent = spark.sparkContext.broadcast(columns)
    kept = [c for c in aligned.columns if c not in ("pairs", "links")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy()
            links = batch.column("links").flatten().to_numpy()
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], links[hit] * n[at[hit]])
            np.add.at(bests, row[hit], links[hit] * best[at[hit]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            offsets = pa.array(rest, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(bests), pa.array(sums),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs[~hit], pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(links[~hit], pa.int64()))],
                [*kept, "n_best", "count_sum", "_pairs", "_links"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    scored = aligned.mapInArrow(run, f"{fields}, n_best long, count_sum long, _pairs array<long>, _links array<long>")
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    others = scored.select("_row", F.explode(F.arrays_zip("_pairs", "_links")).alias("_one")).select(
        "_row", F.col("_one._pairs").alias("pair"), F.col("_one._links").alias("_links"))
    rare = counts.where(F.col("n") < least).select("pair", "n", "best")
    sums = others.join(rare, "pair").groupBy("_row").agg(
        F.sum(F.col("_links") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("_links") * F.col("n")).alias("_sum"))
    return lookup(scored, sums, ["_row"]).select(
        *kept, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def align_corpus(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum``; rows as in ``align_tokens``."""
    aligned = materialize(align_tokens(docs, path_a, path_b, id_col, text_col, digest), "aligned")
    return score_links(aligned, materialize(pair_counts(aligned), "pair-counts"))
