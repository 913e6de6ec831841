"""Benchmark decontamination: test items found in documents by a generalised suffix automaton.

Texts are sequences of words (``words_of``). The automaton of all items has a state for every class of word
sequences that end at the same places of the items; reading a document word by word keeps the longest sequence
that ends there and occurs in some item. Once it is ``window`` words long, the words of that window are hit, and
the state of the last ``window`` words names every item that holds them. An item shorter than a window is found
when a matched sequence ends with the whole of it.

Automata are built by tasks. Items are cut into overlapping pieces, dealt to shards of bounded size, so that a
benchmark of any size gives automata of a known size; a few of them at a time are broadcast, and documents make
one pass for every such handful (one pass for up to ``SHARD_WORDS * SHARDS_AT_ONCE`` words).
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import prepare

#: Words of a shard's items, about; an automaton takes up to some 70 bytes a word. Words of one piece of an item.
SHARD_WORDS, PIECE_WORDS = 1_000_000, 50_000
#: Automata a worker holds during one pass over the documents.
SHARDS_AT_ONCE = 2

# A-Z in lower case; other ASCII than letters and digits separates words (fixed by the definition of a word)
_PLAIN = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if byte > 0x7F or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20
    for byte in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and characters beyond ASCII, of a text in UTF-8."""
    return text.translate(_PLAIN).split()


class Builder:
    """States by number, 0 the empty sequence; ``after`` maps a state's next words to states."""

    def __init__(self) -> None:
        self.length, self.link, self.after = [0], [-1], [{}]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.after.append(after)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """A state for the sequences of ``state`` up to one word longer than ``before``."""
        shorter = self._state(self.length[before] + 1, dict(self.after[state]), self.link[state])
        self.link[state] = shorter
        while before >= 0 and self.after[before].get(word) == state:
            self.after[before][word] = shorter
            before = self.link[before]
        return shorter

    def extend(self, last: int, word: int) -> int:
        """The state of the sequence so far and ``word``; ``last`` is that of the sequence so far."""
        known = self.after[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.after[last]:
            self.after[last][word] = new
            last = self.link[last]
        if last >= 0:
            known = self.after[last][word]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        return new


def build(pieces: Iterable[tuple[str, bool, list[bytes]]], window: int) -> bytes:
    """The automaton of (item, whether it is whole, words), packed.

    Arrays by state: ``length``, ``link``, ``full`` (the state of the last ``window`` words, -1 if there are not so
    many), ``short`` (the nearest state on the way along the links, itself included, that is a whole item below the
    window), ``first`` edge and ``first_item``; behind them the edges, sorted by word, and the items of the states.
    """
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    builder = Builder()
    read = []
    for item, whole, words in pieces:
        ids = [numbers.setdefault(word, len(numbers)) for word in words]
        last = 0
        for word in ids:
            last = builder.extend(last, word)
        read.append((names.setdefault(item, len(names)), whole, ids))
    length, link, after = builder.length, builder.link, builder.after
    n = len(length)
    full, short, items = [-1] * n, [-1] * n, {}
    by_length = sorted(range(n), key=length.__getitem__)
    for state in by_length[1:]:
        if length[state] >= window:
            full[state] = state if length[link[state]] < window else full[link[state]]
    for item, whole, ids in read:
        state = 0
        for at, word in enumerate(ids, 1):
            state = after[state][word]
            if at >= window:
                items.setdefault(full[state], set()).add(item)
        if whole and 0 < len(ids) < window:
            items.setdefault(state, set()).add(item)
            short[state] = state
    for state in by_length[1:]:
        if short[state] < 0:
            short[state] = short[link[state]]
    edges = [sorted(e.items()) for e in after]
    held = [sorted(items.get(state, ())) for state in range(n)]
    arrays = {
        "length": length, "link": link, "full": full, "short": short,
        "first": [0, *accumulate(map(len, edges))], "first_item": [0, *accumulate(map(len, held))],
        "word": [word for e in edges for word, _ in e], "next": [state for e in edges for _, state in e],
        "item": list(chain.from_iterable(held)),
    }
    return pickle.dumps({"words": list(numbers), "names": list(names), "window": window} | {
        name: array("i", values).tobytes() for name, values in arrays.items()})


class Automaton:
    def __init__(self, packed: bytes) -> None:
        whole = pickle.loads(packed)
        self.window, self.names = whole["window"], whole["names"]
        self.number = {word: at for at, word in enumerate(whole["words"])}
        view = lambda name: memoryview(whole[name]).cast("i")
        self.length, self.link, self.full, self.short = map(view, ("length", "link", "full", "short"))
        self.first, self.first_item, self.word, self.next, self.item = map(
            view, ("first", "first_item", "word", "next", "item"))
        self.start = dict(zip(self.word[: self.first[1]], self.next[: self.first[1]]))
        self.any_short = any(state >= 0 for state in self.short)

    def find(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit places as start, end, start, end ... (ends exclusive, apart from each other) and the items found."""
        start, first, edge, target, link, length = self.start, self.first, self.word, self.next, self.link, self.length
        window, full, any_short = self.window, self.full, self.any_short
        spans: list[int] = []
        found: set[int] = set()
        state = matched = 0
        for at, word in enumerate(map(self.number.get, words), 1):
            if word is None:
                state = matched = 0
                continue
            while state:
                low, high = first[state], first[state + 1]
                if high - low > 1:
                    low = bisect_left(edge, word, low, high)
                if low < high and edge[low] == word:
                    state = target[low]
                    matched += 1
                    break
                state = link[state]
                matched = length[state]
            else:
                state, matched = start[word], 1
            if matched >= window:
                _cover(spans, at - window, at)
                found.add(full[state])
            if any_short:
                whole = self.short[state]
                if whole == state and matched < length[state]:
                    whole = self.short[link[state]]
                while whole > 0:
                    _cover(spans, at - length[whole], at)
                    found.add(whole)
                    whole = self.short[link[whole]]
        first_item, item, names = self.first_item, self.item, self.names
        return spans, {names[item[k]] for s in found for k in range(first_item[s], first_item[s + 1])}


def _cover(spans: list[int], start: int, end: int) -> None:
    """Add a span that ends no earlier than those before it."""
    while spans and spans[-1] >= start:
        start = min(start, spans[-2])
        del spans[-2:]
    spans += (start, end)


def _united(spans: Iterable[int]) -> list[int]:
    """Spans in any order, as spans apart from each other in ascending order."""
    flat = iter(spans)
    out: list[int] = []
    for start, end in sorted(zip(flat, flat)):
        if out and out[-1] >= start:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def build_automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``shard, automaton``: the automata of all items, each of a bounded number of words.

    Items without a word (null and empty texts) are found nowhere. Repeated rows count once; rows of one id are one
    item; a null id is named by the empty text.
    """
    prepare(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, whole, parts, counts = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                step = PIECE_WORDS - window + 1  # pieces share what a window needs
                for at in range(0, max(1, len(words) - window + 1), step):
                    part = words[at : at + PIECE_WORDS]
                    names.append(name)
                    whole.append(len(part) == len(words))
                    parts.append(b" ".join(part))
                    counts.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(whole, pa.bool_()), pa.array(parts, pa.binary()), pa.array(counts, pa.int32())],
                ["item", "whole", "words", "n"])

    named = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    pieces = materialize(named.mapInArrow(cut, "item string, whole boolean, words binary, n int").where("n > 0"), "item-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = -(-total // SHARD_WORDS)

    def of_shard(shard: pa.Table) -> pa.Table:
        rows = zip(shard["item"].to_pylist(), shard["whole"].to_pylist(), shard["words"].to_pylist())
        packed = build(((item, whole, words.split()) for item, whole, words in rows), window)
        return pa.table({"shard": pa.array([shard["shard"][0].as_py()], pa.int32()), "automaton": pa.array([packed], pa.binary())})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, shards))).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(of_shard, "shard int, automaton binary"), "automata")


_loaded: dict[str, Automaton] = {}


def _automata(sent: dict[str, Broadcast[bytes]]) -> list[Automaton]:
    """The automata of this pass, unpacked once by each Python worker; those of an earlier pass go."""
    for other in set(_loaded).difference(sent):
        del _loaded[other]
    for key in set(sent).difference(_loaded):
        _loaded[key] = Automaton(sent[key].value)
    return [_loaded[key] for key in sent]


def mark_documents(
    docs: DataFrame, automata: DataFrame, text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, with ``n_words, n_hit, spans, items``.

    ``spans`` holds the hit places as start, end, start, end ... in words, ends exclusive; ``items`` the names of the
    items found, sorted. A null text has no words. Repeated rows and null ids are rows like others; an empty table
    of either kind gives no rows and no hits. New columns that clash with one of ``keep`` are refused.
    """
    spark = prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    clash = {"n_words", "n_hit", "spans", "items"}.intersection(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    shards = [r["shard"] for r in automata.select("shard").orderBy("shard").collect()]
    passes = [shards[at : at + SHARDS_AT_ONCE] for at in range(0, len(shards), SHARDS_AT_ONCE)] or [[]]
    found = "struct<n_words:bigint,spans:array<int>,items:array<string>>"
    others = F.struct(*[F.col(c) for c in keep], F.lit(0).cast("byte").alias("_none"))
    rows = docs.select(others.alias("_row"), F.col(text_col).alias("_text"), F.lit(None).cast(found).alias("_found"))
    kind = rows.schema["_row"].dataType.simpleString()
    for n, group in enumerate(passes):
        last = n == len(passes) - 1
        # each automaton has a bounded size, and so has a pass
        packed = [bytes(automata.where(F.col("shard") == shard).first()["automaton"]) for shard in group]
        sent = {uuid.uuid4().hex: spark.sparkContext.broadcast(one) for one in packed}

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            loaded = _automata(sent)
            for batch in batches:
                out = []
                before = batch.column("_found").to_pylist()
                for text, known in zip(batch.column("_text").cast(pa.binary()).to_pylist(), before):
                    words = words_of(text or b"")
                    spans, items = (known["spans"], set(known["items"])) if known else ([], set())
                    for automaton in loaded:
                        more, names = automaton.find(words)
                        spans = _united(spans + more) if spans and more else spans or more
                        items |= names
                    out.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
                marks = pa.array(out, pa.struct([
                    ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))
                text = pa.nulls(len(out), pa.string()) if last else batch.column("_text")
                yield pa.RecordBatch.from_arrays([batch.column("_row"), text, marks], ["_row", "_text", "_found"])

        rows = rows.mapInArrow(run, f"_row {kind}, _text string, _found {found}")
        if not last:
            rows = materialize(rows, "marked")
    sizes = F.transform("_found.spans", lambda edge, at: F.when(at % 2 == 1, edge).otherwise(-edge))
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in keep], F.col("_found.n_words").alias("n_words"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_hit"),
        F.col("_found.spans").alias("spans"), F.col("_found.items").alias("items"))


def remove_contamination(
    docs: DataFrame, automata: DataFrame, least_span: int, most_coverage: float, text_col: str = "text",
) -> DataFrame:
    """``docs`` without test items: spans of ``least_span`` or more hit words are cut out of the texts, and rows whose
    hit words exceed the share ``most_coverage`` of all words go.

    A cut runs from the first to the last character of the span's words. Other texts stay as they are, null ones too.
    """
    columns = docs.columns
    marked = mark_documents(docs.select(F.struct(*columns).alias("_doc"), F.col(text_col).alias("_of")), automata, "_of", ["_doc", "_of"])
    kept = marked.where(F.col("n_hit") <= F.col("n_words") * most_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("_of").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                pairs = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a >= least_span]
                if pairs:
                    places = [m.span() for m in _WORD.finditer(text)]
                    at, left = 0, []
                    for a, b in pairs:
                        left.append(text[at : places[a][0]])
                        at = places[b - 1][1]
                    text = b"".join([*left, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.binary()).cast(pa.string())], ["_doc", "_of"])

    kind = kept.schema["_doc"].dataType.simpleString()
    cleaned = kept.select("_doc", "_of", "spans").mapInArrow(run, f"_doc {kind}, _of string")
    return cleaned.select(*[(F.col("_of") if c == text_col else F.col("_doc")[c]).alias(c) for c in columns])
