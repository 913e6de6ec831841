"""Decontamination against a table of all windows."""

import hashlib
import random
import re

import pytest
from frames import docs, edge_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from quotewright.llm import decontaminate as d
from quotewright.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=10):
    """(doc_id, words, hit places, items) of each row."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for at in range(max(1, len(words) - window + 1)):
            if words:
                windows.setdefault(tuple(words[at : at + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words = plain_words(text)
        hit, found = set(), set()
        for k in sizes:
            for at in range(len(words) - k + 1):
                names = windows.get(tuple(words[at : at + k]))
                if names:
                    hit.update(range(at, at + k))
                    found |= names
        out.append((i, len(words), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, None) for i, t in items], "item_id bigint, text string, shard int")


def of(df):
    flat = lambda s: sorted(x for a, b in zip(s[::2], s[1::2]) for x in range(a, b))
    rows = df.collect()
    assert all(r["n_hit"] == len(flat(r["spans"])) for r in rows)
    assert all(a < b for r in rows for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], flat(r["spans"]), r["items"]) for r in rows), key=str)


few = st.lists(st.sampled_from("abc"), max_size=14).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(few, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 6))
def test_automaton(items, words, window):
    pieces = [(str(n), True, d.words_of(t.encode())) for n, t in enumerate(items)]
    spans, names = d.Automaton(d.build(pieces, window)).find([w.encode() for w in words])
    (_, _, hit, found), = brute([(0, " ".join(words))], list(enumerate(items)), window)
    assert [x for a, b in zip(spans[::2], spans[1::2]) for x in range(a, b)] == hit and sorted(names) == found


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text(st.sampled_from("aZé0 _-@[`{\x7f\x80\xa0İΣ\n"), max_size=20))
def test_words(text):
    assert d.words_of(text.encode()) == [w.encode() for w in plain_words(text)]


def planted():
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("alpha beta gamma delta eps zeta eta Theta".split()) for _ in range(n))
    items = [(n, text(draw.randrange(12, 40))) for n in range(30)] + [(50, "Two words"), (51, "one"), (52, ""), (None, text(15)), (53, None)]
    items += [items[3], (54, items[4][1]), (5, text(20))]  # a repeated row, one text under two ids, one id with two texts
    rows = edge_rows() + [(100 + n, f"{text(30)} {items[n][1]}, {text(12)}") for n in range(30)]
    return rows + [(200, "two WORDS apart, two words"), (201, items[3][1].replace(" ", "\n--")), (202, text(3000))], items


@pytest.mark.parametrize("shard,piece,window", [(10**6, 50_000, 10), (60, 25, 10), (200, 12, 5)])
def test_edges(spark, monkeypatch, shard, piece, window):
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    monkeypatch.setattr(d, "PIECE_WORDS", piece)
    rows, items = planted()
    automata = d.build_automata(items_frame(spark, items), window)
    assert shard > 1000 or automata.count() > d.SHARDS_AT_ONCE  # several passes
    got = d.mark_documents(docs(spark, rows), automata, keep=["doc_id"])
    assert of(got) == brute(rows, items, window)


def test_empty_tables(spark):
    none = d.build_automata(items_frame(spark, [(1, None), (2, " -")]))
    assert none.count() == 0
    assert of(d.mark_documents(docs(spark, [(1, "a b"), (2, None)]), none, keep=["doc_id"])) == [(1, 2, [], []), (2, 0, [], [])]
    some = d.build_automata(items_frame(spark, [(1, "a b")]))
    assert d.mark_documents(docs(spark, []), some).count() == 0
    with pytest.raises(ValueError):
        d.mark_documents(docs(spark, []).withColumnRenamed("lang", "spans"), some)


def test_remove(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    rows = [(1, f"Before, {item}! after it came more words and more words again"), (2, f"x {item}"), (3, None), (4, "été clean.")]
    df = docs(spark, rows)
    out = d.remove_contamination(df, d.build_automata(items_frame(spark, [(7, item)])), least_span=10, most_coverage=0.6)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [
        (1, "Before, ! after it came more words and more words again"), (3, None), (4, "été clean.")]
    long_only = d.remove_contamination(df, d.build_automata(items_frame(spark, [(7, item)])), least_span=11, most_coverage=1.0)
    assert sorted((r["doc_id"], r["text"]) for r in long_only.collect()) == sorted(rows)


def test_op13_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    got = QUERIES["op13_decontamination"](spark, "/root/testdata/sf0.01").select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = [(i, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
            for i, n, hit, names in brute(rows, items)]
    assert sorted(map(tuple, got)) == sorted(want) and any(w[5] for w in want)
