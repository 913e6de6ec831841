"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from frames import docs, edge_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quotewright.llm import variants as v
from quotewright.llm.queries import QUERIES

LOWER = str.maketrans(v.UPPER, v.LOWER)


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, misspell=31):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(LOWER)
            code = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if misspell and code % misspell == 0:
                word = word[: code % len(word)] + word[code % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(words, ratio=10, pairs=None):
    linked = {w: set() for w in words}
    for a, b in pairs if pairs is not None else combinations(words, 2):
        if near(a, b):
            linked[a].add(b)
            linked[b].add(a)
    forms = {}
    for w, n in words.items():
        best = min(linked[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, n, len(linked[w]), words[form] if form else None))
    return sorted(out, key=str)


def of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


few = st.lists(st.text("abé", min_size=1, max_size=7), max_size=25, unique=True)


@settings(max_examples=200, deadline=None)
@given(few)
def test_every_pair_belongs_to_one_signature(words):
    rows = sorted((sig, w) for w, sigs in zip(words, v.signatures(words).tolist() if words else []) for sig in sigs)
    sig, some = np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows]
    low, high = v.pairs_within(some, sig) if rows else ([], [])
    got = sorted(tuple(sorted((some[i], some[j]))) for i, j in zip(low, high))
    assert got == sorted(tuple(sorted(p)) for p in combinations(words, 2) if near(*p))


def few_letters():
    draw = np.random.default_rng(1)
    words = {"".join(draw.choice(list("abcé"), draw.integers(7, 9))): int(10 ** draw.uniform(0.4, 5)) for _ in range(700)}
    return words | {"x" * 3000 + "a": 5, "x" * 3000 + "b": 900, "x" * 3000: 3, "baaaaaaaa" * 1000: 4}


@pytest.mark.parametrize("letters,sample", [(1 << 20, 64), (300, 64), (16, 1)])
def test_words_of_few_letters(spark, monkeypatch, letters, sample):
    # all buckets at once, bucket by bucket, the large ones dealt out
    monkeypatch.setattr(v, "LETTERS", letters)
    monkeypatch.setattr(v, "SAMPLE", sample)
    monkeypatch.setattr(v, "SLOTS_PER_TASK", 100 if sample == 1 else 4)
    words = few_letters()
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    dealt = []
    monkeypatch.setattr(v, "_near_dealt_out", lambda signed, f=v._near_dealt_out: dealt.append(signed.count()) or f(signed))
    assert of(v.spelling_variants(df)) == brute(words)
    assert bool(dealt) == (sample == 1) and all(0 < n < 15 * len(words) for n in dealt)


def test_chain_of_forms(spark):
    words = {"abcdefg" + "h" * k: 2 * 10**k for k in range(9)} | {"abcdefh": 2, "zzzzzzz": 7, "zzzzzzy": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = of(v.spelling_variants(df))
    assert got == brute(words)
    assert {r[2] for r in got} == {"abcdefg" + "h" * 8, "zzzzzzz", "zzzzzzy"}


def test_edges(spark):
    rows = edge_rows() + [(30, "Straße STRAßEN straßen straßen Älteren älteren Älteren ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ a×bcdefg a×bcdefg"), (31, "abcdefg1abcdefg_Abcdefg")]
    rows += [(k, "Alphabet alphabet spelling " * 3) for k in range(200)] + [(None, "spelling spelling")]
    for misspell in (None, 31):
        words = v.count_words(docs(spark, rows), misspell=misspell)
        want = brute_words(rows, misspell)
        assert {r["word"]: r["n"] for r in words.collect()} == want
        assert of(v.spelling_variants(words)) == brute(want)
    assert v.spelling_variants(v.count_words(docs(spark, []))).count() == 0


def test_op11_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    words = brute_words(rows)
    # pairs one edit apart share a word without one letter, or one is the other without it
    rests = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rests.setdefault(rest, []).append(w)
    pairs = {tuple(sorted(p)) for some in rests.values() for p in combinations(some, 2)}
    got = of(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01"))
    assert got == brute(words, pairs=pairs) and any(r[1] for r in got)
