"""Language of a document, word by word, by a linear-chain conditional random field in numpy.

Each word gets evidence for every language from hashed byte trigrams (its edges included), from its first and
last letters, and from a lexicon of frequent words; learned transitions tie neighbouring words together, so that
a foreign phrase inside a document is labelled as such and a single odd word is not. Forward-backward gives each
word's probabilities; the document's language is the one with the most of them.

Words of many documents are worked on at once: chains are cut into blocks whose products of transitions are
computed side by side, and only the blocks of a document follow each other. The result is exact for the whole
chain, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw_sample, prepare
from .quality import fold_of

#: Buckets of the hashed features, words of a block.
BUCKETS, BLOCK = 1 << 16, 64
#: Documents of each language to learn from, and of all languages, at most; characters of the piece taken of a longer
#: one; lexicon words of each language.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS, LEXICON = 300, 20_000, 20_000, 1000
#: Words of a training chain and of one language in it, chains of a step, steps, step size.
CHAIN, STRETCH, CHAINS, STEPS, RATE = 96, 24, 64, 150, 0.3
#: Words whose evidence is gathered at once.
AT_ONCE = 100_000
UNKNOWN = "und"

_ONE = np.ones(1, np.uint64)
_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_MULTIPLY = np.uint32(2654435761)


@dataclass
class Words:
    """Words of several texts: bytes with everything else blanked, and where each word starts and ends."""

    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        """Words are runs of ASCII letters and of bytes beyond ASCII, in lower case."""
        raw = [(text or "").lower().encode() for text in texts]
        # three blanks around each text: no feature of a word looks into another text
        flat = np.frombuffer(b"   ".join([b"", *raw, b""]), np.uint8)
        letter = _LETTER_BYTE[flat]
        flat = np.where(letter, flat, 32).astype(np.uint8)
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        text_start = 3 + np.cumsum([0] + [len(r) + 3 for r in raw[:-1]])
        return cls(flat, start, end, np.searchsorted(text_start, start, side="right") - 1)

    def __len__(self) -> int:
        return len(self.start)

    def part(self, first: int, last: int) -> Words:
        """Words first to last - 1, with the bytes around them."""
        low, high = self.start[first] - 3, self.end[last - 1] + 3
        return Words(self.flat[low:high], self.start[first:last] - low, self.end[first:last] - low, self.owner[first:last])

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the trigram at each byte, and where each word's trigrams start."""
        return _bucket(self._at(np.arange(len(self.flat) - 2)), 1), self.start - 1

    def _at(self, places: np.ndarray) -> np.ndarray:
        f = self.flat.astype(np.uint32)
        return f[places] | f[places + 1] << np.uint32(8) | f[places + 2] << np.uint32(16)

    def affixes(self) -> np.ndarray:
        """Buckets of the first three and last three bytes of each word."""
        return np.stack([_bucket(self._at(self.start), 2), _bucket(self._at(self.end - 3), 3)], 1)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, wherever it stands."""
        base = np.uint64(0x100000001B3)
        out = np.zeros(len(self), np.uint64)
        length = self.end - self.start
        for i in range(int(min(length.max(initial=0), 24))):  # the length settles longer ones
            on = length > i
            out[on] = (out[on] ^ self.flat[self.start[on] + i]) * base
        return out ^ (length.astype(np.uint64) << np.uint64(56))


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    mixed = (code ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * _MULTIPLY
    return (mixed >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Field:
    """The learned field. ``lexicon`` holds word hashes in ascending order, ``member`` their languages.

    It holds every language that it learned from. With more than 64 of them there are fewer buckets, so that the field
    keeps its size.
    """

    languages: list[str]
    grams: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    known: np.ndarray
    transitions: np.ndarray

    def membership(self, words: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(words), len(self.languages)), np.float32)
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == h)[:, None], self.member[at], 0).astype(np.float32)

    def evidence(self, words: Words) -> np.ndarray:
        """Log-potential of every language for every word."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), AT_ONCE):
            part = words.part(at, min(len(words), at + AT_ONCE))
            bucket, first = part.grams()
            out[at : at + AT_ONCE] = _sum_between(self.grams[bucket & (len(self.grams) - 1)], first, part.end - 1)
            out[at : at + AT_ONCE] += self.affix[part.affixes() & (len(self.affix) - 1)].sum(axis=1) + self.membership(part) @ self.known
        return out

    def marginals(self, words: Words) -> np.ndarray:
        return forward_backward(self.evidence(words), self.transitions, words.owner)[0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the words' probability, for each text."""
        words = Words.of(texts)
        share = np.zeros((len(texts), len(self.languages)))
        if len(words):
            p = self.marginals(words)
            for language in range(len(self.languages)):
                share[:, language] = np.bincount(words.owner, weights=p[:, language], minlength=len(texts))
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        score = np.divide(share.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        lettered = np.array([bool(text and _LETTER.search(text)) for text in texts], bool)
        found = [self.languages[b] if on else UNKNOWN for b, on in zip(best, lettered)]
        return found, np.where(lettered, np.clip(score, 0, 1), 0.0)


    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, probability) of each text's stretches in one language, in code points."""
        words = Words.of(texts)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if not len(words):
            return out
        p = self.marginals(words)
        best = p.argmax(axis=1)
        opens = np.append(True, (best[1:] != best[:-1]) | (words.owner[1:] != words.owner[:-1]))
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(words)) - 1
        mean = np.add.reduceat(p[np.arange(len(words)), best], first) / (last - first + 1)
        places = [_places(text) if text and _LETTER.search(text) else None for text in texts]
        text_start = 3 + np.cumsum([0] + [len((text or "").lower().encode()) + 3 for text in texts[:-1]])
        for a, b, probability in zip(first.tolist(), last.tolist(), mean.tolist()):
            owner = int(words.owner[a])
            if places[owner] is None:
                continue
            start, end = words.start[a] - text_start[owner], words.end[b] - text_start[owner]
            at = places[owner]
            out[owner].append((int(at[start]), int(at[end - 1]) + 1, self.languages[best[a]], probability))
        return out


def _places(text: str) -> np.ndarray:
    """The code point of ``text`` that each byte of its lower-cased form comes from."""
    lower = text.lower()
    if len(lower) != len(text):  # some characters have a longer lower case
        sizes = [len(c.lower().encode()) for c in text]
    elif lower.isascii():
        return np.arange(len(lower))
    else:
        sizes = [len(c.encode()) for c in lower]
    return np.repeat(np.arange(len(text)), sizes)


def _sum_between(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of rows[first:last] for ascending, separate stretches."""
    if not len(first):
        return np.zeros((0, rows.shape[1]), np.float32)
    bounds = np.stack([first, last], 1).ravel()
    return np.add.reduceat(rows, bounds, axis=0)[::2].astype(np.float32)


def _normalised(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def forward_backward(
    evidence: np.ndarray, transitions: np.ndarray, owner: np.ndarray, pairs: bool = False,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of every word's labels in chains given by ``owner``; with ``pairs`` the expected transitions too."""
    n, k = evidence.shape
    psi = np.exp(evidence - evidence.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = np.exp(transitions - transitions.max()).astype(np.float64)
    opens = np.concatenate([[True], owner[1:] != owner[:-1]])
    # blocks: the words of a chain, BLOCK at a time
    chain_start = np.flatnonzero(opens)
    in_chain = np.arange(n) - np.repeat(chain_start, np.diff(np.append(chain_start, n)))
    block = np.cumsum(opens | (in_chain % BLOCK == 0)) - 1
    block_start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.append(block_start, n))
    blocks = len(block_start)
    block_opens = opens[block_start]
    by_size = np.argsort(-size, kind="stable")
    counts = [int(np.searchsorted(-size[by_size], -t, side="left")) for t in range(BLOCK)]  # blocks longer than t
    start = block_start[by_size]
    fresh = block_opens[by_size]

    def move(t: int, upto: int) -> np.ndarray:
        """Step into word t of the first blocks; a chain's first word is stepped into from nowhere."""
        if t:
            return np.broadcast_to(step, (upto, k, k))
        return np.where(fresh[:upto, None, None], 1.0, step)

    # product of the steps of each block
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(int(size.max(initial=0))):
        upto = counts[t]
        now = product[:upto] @ move(t, upto) * psi[start[:upto] + t][:, None, :]
        product[:upto] = now / now.sum(axis=(1, 2), keepdims=True)
    place = np.empty(blocks, np.int64)
    place[by_size] = np.arange(blocks)

    # the blocks of a chain follow each other, chains side by side
    first_block = np.flatnonzero(block_opens)
    length = np.diff(np.append(first_block, blocks))
    order = np.argsort(-length, kind="stable")
    first_block, length = first_block[order], length[order]
    before, behind = np.full((blocks, k), 1 / k), np.full((blocks, k), 1 / k)
    active = [int(np.searchsorted(-length, -j, side="left")) for j in range(int(length.max(initial=0)))]
    for j in range(1, len(active)):
        here = first_block[: active[j]] + j
        before[here] = _normalised(np.einsum("bi,bij->bj", before[here - 1], product[place[here - 1]]))
    for j in range(len(active) - 1, 0, -1):
        here = first_block[: active[j]] + j
        behind[here - 1] = _normalised(np.einsum("bij,bj->bi", product[place[here]], behind[here]))

    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = before[by_size]
    for t in range(int(size.max(initial=0))):
        upto = counts[t]
        state[:upto] = _normalised(
            np.einsum("bi,bij->bj", state[:upto], move(t, upto)) * psi[start[:upto] + t])
        forward[start[:upto] + t] = state[:upto]
    state = behind[by_size]
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        upto = counts[t]
        backward[start[:upto] + t] = state[:upto]
        state[:upto] = _normalised(
            np.einsum("bij,bj->bi", move(t, upto), psi[start[:upto] + t] * state[:upto]))
    marginal = _normalised(forward * backward)
    if not pairs:
        return marginal, None
    inner = np.flatnonzero(~opens)
    joint = forward[inner - 1][:, :, None] * step * (psi[inner] * backward[inner])[:, None, :]
    return marginal, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _lexicon(words: Words, label: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of each language and the languages they are frequent in."""
    h = words.hashes()
    chosen = []
    for language in range(languages):
        values, counts = np.unique(h[label == language], return_counts=True)
        chosen.append(np.sort(values[np.argsort(-counts, kind="stable")[:LEXICON]]))
    lexicon = np.unique(np.concatenate(chosen))
    return lexicon, np.stack([np.isin(lexicon, c) for c in chosen], 1).astype(np.float32)


def train(texts: list[str], langs: list[str], seed: int = 11) -> Field | None:
    """A field from texts and the language of each (stochastic gradients, AdaGrad); None without a word.

    Chains are put together from stretches of documents in all languages, so that the transitions learn what
    switching looks like.
    """
    languages = sorted(set(langs))
    words = Words.of(texts)
    if not len(words):
        return None
    k = len(languages)
    label = np.array([languages.index(lang) for lang in langs])[words.owner]
    lexicon, member = _lexicon(words, label, k)
    buckets = max(1 << 10, BUCKETS >> max(0, (k - 1).bit_length() - 6))
    net = Field(languages, np.zeros((buckets, k), np.float32), np.zeros((buckets, k), np.float32), lexicon, member,
                np.zeros((k, k), np.float32), np.zeros((k, k), np.float32))
    bucket, first = words.grams()
    bucket &= buckets - 1
    affixes, membership = words.affixes() & (buckets - 1), net.membership(words)
    spans = [np.arange(a, b) for a, b in zip(first, words.end - 1)]
    by_language = [np.flatnonzero(label == language) for language in range(k)]
    draw = np.random.default_rng(seed)
    squares = [np.full_like(x, 1e-2) for x in (net.grams, net.affix, net.known, net.transitions)]
    for _ in range(STEPS):
        rows = []
        for _ in range(CHAINS):
            for _ in range(CHAIN // STRETCH):
                own = by_language[draw.integers(k)]
                if len(own):
                    at = draw.integers(max(1, len(own) - STRETCH))
                    rows.append(own[at : at + draw.integers(2, STRETCH + 1)])
        owner = np.repeat(np.arange(len(rows)) // (CHAIN // STRETCH), [len(r) for r in rows])
        row = np.concatenate(rows)
        places = [spans[r] for r in row]
        owner_of_place = np.repeat(np.arange(len(row)), [len(p) for p in places])
        gram = bucket[np.concatenate(places)]
        evidence = np.stack([
            np.bincount(owner_of_place, weights=net.grams[gram, j], minlength=len(row)) for j in range(k)], 1)
        evidence += net.affix[affixes[row]].sum(axis=1) + membership[row] @ net.known
        marginal, expected = forward_backward(evidence, net.transitions, owner, pairs=True)
        gradient = (marginal - np.eye(k)[label[row]]) / CHAINS
        seen = np.zeros((k, k))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        np.add.at(seen, (label[row][inner], label[row][inner + 1]), 1)
        spread = lambda at, g: np.stack(
            [np.bincount(at, weights=g[:, j], minlength=buckets) for j in range(k)], 1)
        gradients = [
            spread(gram, gradient[owner_of_place]),
            spread(affixes[row].ravel(), np.repeat(gradient, 2, axis=0)),
            membership[row].T @ gradient, (expected - seen) / CHAINS,
        ]
        for weights, square, g in zip((net.grams, net.affix, net.known, net.transitions), squares, gradients):
            square += g * g
            weights -= (RATE * g / np.sqrt(square)).astype(np.float32)
    return net


def learn(
    docs: DataFrame, fold_out: int = 1, folds: int = 3,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Field | None:
    """Train on ``SAMPLE_ROWS`` documents of each language outside the held-out fold, or on all there are; None if there
    is no such word.

    Every language is learned. The sample is picked by hashes (``draw_sample``) and the only data that reaches the
    driver; of longer texts it holds a piece of ``SAMPLE_CHARS`` characters. With very many languages each has fewer
    documents, ``SAMPLE_TOTAL`` together, but 4 at least.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != fold_out))
    languages = known.agg(F.count_distinct("label")).first()[0]
    sample = draw_sample(known, min(SAMPLE_ROWS, max(4, SAMPLE_TOTAL // max(1, languages))), SAMPLE_CHARS)
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def identify(
    docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score``: one row per input row, whole texts.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a field (nothing to
    learn from). Ties go to the first language in order. Null ids and repeated rows pass through; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if sent.value is None:
                found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                found, score = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_spans(
    docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, spans``: the stretches of each whole text in one language, one row per input row.

    ``spans`` is an array of ``struct(start, end, lang, probability)``: neighbouring words with the same likeliest
    language, from the first character of the first one to the last of the last (code points, end exclusive), and
    the mean probability of that language over them. A text that is null or without a letter has none, as have all
    texts without a field. Null ids and repeated rows pass through; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [[] for _ in texts] if sent.value is None else sent.value.spans(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,lang:string,probability:double>>")
