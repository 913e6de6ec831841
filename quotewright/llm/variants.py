"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is a multiset of letters, that is a binary vector with one dimension for each letter and occurrence (the
second ``e`` is a dimension of its own). One inserted, deleted or replaced letter changes at most two dimensions,
so near words are at a Hamming distance of at most two. The dimensions are partitioned into ``PARTS`` parts; a
signature is the vector on all parts but two, for each choice of the two. Two vectors that differ in at most two
dimensions are equal on some choice: an equi-join on signatures loses no pair. A pair belongs to the first choice
on which it is equal, so that it is counted once.

Words of one signature (a bucket) meet in one task. They are not compared pair by pair, as words of the same
letters in another order share all signatures: what is left of each word without one letter is hashed, equal rests
give the candidates, and those are verified letter by letter. Each word of a bucket sends on one row, however many
near words it has there. A bucket beyond a share of a task is dealt out by those rests instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import materialize
from .common import prepare

#: Parts of the letter dimensions; a signature leaves two of them out, and its low bits say which.
PARTS = 6
CHOICES = list(combinations(range(PARTS), 2))
LOW = np.uint64(15)
#: Letters that a worker compares at once.
LETTERS = 1 << 20
#: Buckets of more than a task's share of rows, divided by this, are dealt out. Sizes come from one word in SAMPLE.
SLOTS_PER_TASK, SAMPLE = 4, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1  # odd, so that it has an inverse among 64-bit numbers


def count_words(
    docs: DataFrame, least_length: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text",
    misspell: int | None = None,
) -> DataFrame:
    """``word, n``: runs of Latin letters, A-Z in lower case, of at least so many code points and occurrences.

    With ``misspell``, the CRC-32 of ``<id>:<run>`` decides whether a run loses a letter (where that number divides
    it) and which one. Null texts have no words; a null id counts as the empty text; repeated rows count each.
    """
    letters = rf"[A-Za-zÀ-ÿ]{{{least_length},}}"  # shorter runs cannot become words
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(letters), F.lit(0))).alias("_run"),
    ).select("_id", F.translate("_run", UPPER, LOWER).alias("word"))
    if misspell:
        code = F.crc32(F.concat("_id", F.lit(":"), "word"))
        place = (code % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        runs = runs.select(F.when(code % misspell == 0, shorter).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the word each belongs to, and where each word starts."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(word) for word in words], np.int64)
    return points, np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths) - lengths


def _parts(words: list[str]) -> np.ndarray:
    """One row per word: a hash of its vector on each part."""
    points, owner, _ = _letters(words)
    order = np.lexsort((points, owner))
    points = points[order]
    fresh = np.ones(len(points), bool)
    fresh[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    places = np.arange(len(points))
    occurrence = (places - np.maximum.accumulate(np.where(fresh, places, 0))).astype(np.uint64)
    # the sum over a part's dimensions does not depend on their order
    parts = np.zeros((len(words), PARTS), np.uint64)
    dimension = _mixed((points << np.uint64(32)) + occurrence + np.uint64(1))
    np.add.at(parts, (owner, ((points + occurrence) % np.uint64(PARTS)).astype(np.int64)), dimension)
    return parts


def signatures(words: list[str]) -> np.ndarray:
    """One row per word, one column for each choice of two parts left out."""
    parts = _parts(words)
    whole = parts.sum(axis=1, dtype=np.uint64)
    return np.stack([
        _mixed(whole - parts[:, a] - parts[:, b]) & ~LOW | np.uint64(choice)
        for choice, (a, b) in enumerate(CHOICES)], axis=1)


def _first_choices() -> np.ndarray:
    """By the parts in which two words differ, as bits: the first choice that leaves those out, or -1."""
    differing = [{part for part in range(PARTS) if bits >> part & 1} for bits in range(1 << PARTS)]
    return np.array([next((k for k, two in enumerate(CHOICES) if parts <= set(two)), -1) for parts in differing])


FIRST = _first_choices()


def _choice_of(parts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return FIRST[(parts[i] != parts[j]) @ (1 << np.arange(PARTS))]


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)), dtype=np.uint64)


def without_one(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of all words: its word, its place, and a hash of the word without it. Linear in the letters."""
    points, owner, starts = _letters(words)
    lengths = np.diff(np.append(starts, len(points)))
    place = np.arange(len(points)) - starts[owner]
    powers = _powers(max(lengths, default=0))
    terms = (points + np.uint64(1)) * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    before = sums[:-1] - sums[starts[owner]]
    behind = sums[(starts + lengths)[owner]] - sums[1:]
    return owner, place, before + behind * np.uint64(pow(_BASE, -1, 1 << 64))


def whole_hashes(words: list[str]) -> np.ndarray:
    """The hash that ``without_one`` would give, of each word whole."""
    points, owner, starts = _letters(words)
    place = np.arange(len(points)) - starts[owner]
    powers = _powers(max(map(len, words), default=0))
    out = np.zeros(len(words), np.uint64)
    np.add.at(out, owner, (points + np.uint64(1)) * powers[place])
    return out


def _rest_keys(words: list[str], sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter its word's number, and two keys of the rest without it; for each word a key of the whole.

    Words with an equal first key differ in one letter at one place; a second key equal to the key of a whole word
    is that word with a letter more. Keys hold within one signature.
    """
    owner, place, rest = without_one(words)
    replaced = _mixed(rest + place.astype(np.uint64) * np.uint64(2) + np.uint64(3)) ^ _mixed(sig[owner])
    shorter = rest ^ _mixed(sig[owner])
    return owner, replaced, shorter, whole_hashes(words) ^ _mixed(sig)


def _equal_pairs(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of owners with equal keys; near words replaced at one place, so at most as many as letters there are."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    left, right = [], []
    step, open_ = 1, np.arange(len(key))
    while True:
        open_ = open_[open_ + step < len(key)]
        open_ = open_[key[open_] == key[open_ + step]]
        if not len(open_):
            break
        left.append(owner[open_])
        right.append(owner[open_ + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def pairs_within(words: list[str], sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the numbers of near words that share a signature and belong to it, each once; linear in the letters."""
    owner, replaced, shorter, whole = _rest_keys(words, sig)
    left, right = _equal_pairs(replaced, owner)
    by_whole = np.argsort(whole)
    at = np.searchsorted(whole[by_whole], shorter)
    met = np.flatnonzero(at < len(whole))
    met = met[whole[by_whole[at[met]]] == shorter[met]]
    left, right = np.append(left, owner[met]), np.append(right, by_whole[at[met]])
    low, high = np.minimum(left, right), np.maximum(left, right)
    both = np.unique(low * len(words) + high)
    low, high = both // len(words), both % len(words)
    mine = (low != high) & (sig[low] == sig[high])
    low, high = low[mine], high[mine]
    mine = _choice_of(_parts(words), low, high) == (sig[low] & LOW).astype(np.int64)
    low, high = low[mine], high[mine]
    near = np.fromiter((_near(words[i], words[j]) for i, j in zip(low.tolist(), high.tolist())), bool, len(low))
    return low[near], high[near]


def _near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _summary(words: list[str], counts: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with near words, how many each has, and the number of the best of them (the most frequent, then the least)."""
    low, high = pairs_within(words, sig)
    word, near = np.append(low, high), np.append(high, low)
    rank = np.empty(len(words), np.int64)  # the place among all words here, the best first
    rank[sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))] = np.arange(len(words))
    order = np.lexsort((rank[near], word)) if len(word) else np.zeros(0, np.int64)
    some, first, n = np.unique(word[order], return_index=True, return_counts=True)
    return some, n, near[order][first]


def _signed(words: DataFrame) -> DataFrame:
    """``sig, word, n``: each word under each of its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                sigs = signatures(some.column(0).to_pylist())
                of = pa.array(np.repeat(np.arange(len(sigs)), sigs.shape[1]))
                columns = [column.take(of) for column in some.columns]
                yield pa.RecordBatch.from_arrays([pa.array(sigs.reshape(-1).view(np.int64)), *columns], ["sig", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig long, word string, n long")


NEAR = "word string, n_near long, near string, near_n long"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets of rows sorted by signature, as many at a time as have ``LETTERS`` letters, or one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.utf8_length(batch.column(1))).as_py() or 0
        if size >= LETTERS:
            table = pa.Table.from_batches(held)
            sig = table["sig"].to_numpy()
            last = int(np.searchsorted(sig, sig[-1]))  # the last bucket may go on
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            size = sum(pc.sum(pc.utf8_length(b.column(1))).as_py() for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _near_in_buckets(signed: DataFrame) -> DataFrame:
    """``NEAR`` rows of each bucket: a word, how many near words it has there, and the best of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batch for batch in batches if batch.num_rows):
            sig = table["sig"].to_numpy()
            alone = np.ones(len(sig), bool)
            alone[1:] &= sig[1:] != sig[:-1]
            alone[:-1] &= sig[1:] != sig[:-1]
            table, sig = table.filter(pa.array(~alone)), sig[~alone]
            words, counts = table["word"].to_pylist(), table["n"].to_numpy()
            some, n, best = _summary(words, counts, sig.view(np.uint64))
            text = table["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [text.take(pa.array(some)), pa.array(n), text.take(pa.array(best)), pa.array(counts[best])],
                ["word", "n_near", "near", "near_n"])

    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signed.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(run, NEAR)


def _near_dealt_out(signed: DataFrame) -> DataFrame:
    """``NEAR`` rows of buckets that no task should hold: rests of words meet by an equi-join.

    Words travel by number with their rests, and are looked up for the pairs that meet.
    """
    words = materialize(signed.withColumn("id", F.monotonically_increasing_id()), "large-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sig = some.column(0).to_numpy().view(np.uint64)
                owner, replaced, shorter, whole = _rest_keys(some.column(1).to_pylist(), sig)
                of = np.concatenate([owner, owner, np.arange(len(sig))])
                role = np.repeat([0, 1, 2], [len(owner), len(owner), len(sig)]).astype(np.int8)
                key = np.concatenate([replaced, shorter, whole])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(role), some.column(2).take(pa.array(of))], ["key", "role", "id"])

    def sides(rows: DataFrame) -> list[DataFrame]:
        return [rows.withColumnsRenamed({c: f"{side}_{c}" for c in rows.columns}) for side in "ab"]

    a, b = sides(materialize(words.select("sig", "word", "id").mapInArrow(run, "key long, role byte, id long"), "rests"))
    replaced = (F.col("a_role") == 0) & (F.col("b_role") == 0) & (F.col("a_id") < F.col("b_id"))
    deleted = (F.col("a_role") == 1) & (F.col("b_role") == 2) & (F.col("a_id") != F.col("b_id"))
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & (replaced | deleted)).select(
        F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    a, b = sides(words)
    found = met.join(a, "a_id").join(b, "b_id").where(F.col("a_sig") == F.col("b_sig"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            at = np.arange(len(first))
            choice = _choice_of(_parts(first + second), at, at + len(first))
            mine = choice == (batch.column(0).to_numpy().view(np.uint64) & LOW).astype(np.int64)
            mine &= np.fromiter(map(_near, first, second), bool, len(first))
            some = batch.filter(pa.array(mine))
            word, n, near, near_n = some.columns[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([word, near]), pa.array(np.ones(2 * len(word), np.int64)), pa.concat_arrays([near, word]),
                 pa.concat_arrays([near_n, n])], ["word", "n_near", "near", "near_n"])

    return found.select("a_sig", "a_word", "a_n", "b_word", "b_n").mapInArrow(check, NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: words with near words, how many, the most frequent one (ties: the least in
    code-point order) and its count.

    ``words`` (``word, n``) is a written table that has each word once.
    """
    spark = prepare(words.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = words.count() * len(CHOICES)
    share = max(LETTERS // 16, rows // (SLOTS_PER_TASK * parts))
    sizes = _signed(words.where(F.pmod(F.xxhash64("word"), F.lit(SAMPLE)) == 0)).groupBy("sig").agg(F.count(F.lit(1)).alias("_rows"))
    large = materialize(sizes.where(F.col("_rows") * SAMPLE > share).select("sig"), "large-buckets")
    signed = _signed(words)
    if large.isEmpty():
        found = _near_in_buckets(signed)
    else:
        # each holds more than that share of all rows, so there are some SLOTS_PER_TASK * parts of them at most
        few = F.broadcast(large)
        found = _near_in_buckets(signed.join(few, "sig", "left_anti")).unionByName(
            _near_dealt_out(signed.join(few, "sig", "left_semi")))
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``, each word once).

    ``form`` is the most frequent near word (ties: the least in code-point order) if it is at least ``ratio`` times
    as frequent as the word. ``root`` follows the forms to the last; counts grow by ``ratio`` with each step, so
    that chains are short. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "words")
    enough = F.col("near_n") >= F.col("n") * ratio
    found = materialize(lookup(words, near_words(words), ["word"]).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return lookup(found, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root`` at the end of the chains of ``steps``, by doubling; the rounds are the logarithm of the longest."""
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        doubled = materialize(lookup(steps, on, ["root"]).select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        steps = doubled.select("word", "root")
        if doubled.where("_moved").isEmpty():
            return steps
