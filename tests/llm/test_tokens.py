import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from frames import docs, edge_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotewright.llm import bpe, packing, wavelet
from quotewright.llm.hf import FileTokenizer
from quotewright.llm.parts import as_bytes
from quotewright.llm.queries import QUERIES

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "...", ".", ",", "|", "\t", "\x1c", "\u3000", "\xa0", "don't",
          "😀", "\r\n", "Σ", "\u0130", "\u0301", "ª", "\u0958", "<|endoftext|>", " Été", " w.\n", "<|startoftext|>", "<|endoftext|", "|>"]
texts = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20)


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def content(path):
    with open(path, "rb") as file:
        return file.read()


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_tiktoken_parts(plain, some):
    codec = bpe.Codec.of(content(RANKS), P.PATTERN)
    assert codec.encode(some) == [as_bytes(plain.encode_ordinary(t)) for t in some]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizers_parts(name):
    whole = Tokenizer.from_file(P.path(name))  # as the library comes
    ours = FileTokenizer.of(content(P.path(name)))
    draw = random.Random(3)
    some = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(14))) for _ in range(4000)]
    some += [r["text"] for r in table("documents")[:60]]
    want = [as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in some]
    for at in range(0, len(some), 500):
        assert ours.encode(some[at : at + 500]) == want[at : at + 500]


@pytest.mark.parametrize("name,id_", [("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)])
def test_added_tokens(name, id_):
    whole, ours = Tokenizer.from_file(P.path(name)), FileTokenizer.of(content(P.path(name)))
    some = ["a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>word, <|endoftext|><|endoftext|>", "a  <|endoftext|>  b.<|endoftext|>\n",
            " <|endoftext", "<|endoftext|>'s don<|endoftext|>'t", "é\u0301<|endoftext|>\u0301", "x " * 3000 + "<|endoftext|>" + " y" * 3000]
    assert ours.encode(some) == [as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in some]
    assert ours.encode(["<|endoftext|>"]) == [as_bytes([id_])]


def test_added_tokens_that_take_white_space():
    spec = json.loads(content(P.path("byte_bpe_50k.json")))
    spec["added_tokens"][0] |= {"lstrip": True, "rstrip": True}
    text = json.dumps(spec)
    whole, ours = Tokenizer.from_str(text), FileTokenizer(text.encode())
    some = ["a <|endoftext|> b c", "plain text", None, "<|endoftext|>\n x"]
    assert ours.encode(some) == [as_bytes(whole.encode(t or "", add_special_tokens=False).ids) for t in some]


def test_round_trip(spark, plain):
    rows = edge_rows()
    df = docs(spark, rows)
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(df, RANKS, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    encoded = bpe.encode(df, RANKS, P.PATTERN)
    assert sorted(((r["doc_id"], len(r["ids"])) for r in encoded.collect()), key=str) == sorted((w[:2] for w in want), key=str)
    back = bpe.decode(encoded, RANKS, P.PATTERN)
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()), key=str) == sorted(
        ((i, t or "") for i, t in rows), key=str)
    assert bpe.round_trip(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_op2_query(spark, plain):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in table("documents", "/root/testdata/sf0.001"):
        ids = plain.encode_ordinary(r["text"])
        assert got.pop(r["doc_id"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    assert not got


# packing

lengths = st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30)


@settings(max_examples=150, deadline=None)
@given(lengths)
def test_plan_places_every_piece_once(histogram):
    room = {}
    used = {size: [] for size in histogram}
    for size, first, last, k, sequence, offset in packing.plan_windows(histogram, 64):
        used[size] += range(first, last)
        for n in range(first, last):
            at = offset + (n - first) % k * size
            room.setdefault(sequence + (n - first) // k, []).append((at, at + size))
    assert all(sorted(places) == list(range(histogram[size])) for size, places in used.items())
    for spans in room.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(room) == list(range(len(room)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6))
def test_fill_has_the_least_slack(counts):
    from itertools import product

    longest = max(counts)
    left = counts | {longest: counts[longest] - 1}
    chosen = packing._fill(longest, left, 32)
    assert all(chosen[size] <= left[size] for size in chosen)
    sums = [sum(size * k for size, k in zip(left, ks)) for ks in product(*[range(n + 1) for n in left.values()])]
    best = min(packing.slack(longest + s, 32) for s in sums if longest + s <= 32)
    assert packing.slack(longest + sum(size * k for size, k in chosen.items()), 32) == best


def check_packed(rows, df, path):
    whole = Tokenizer.from_file(path)
    got = df.collect()
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if i is None else i, len(ids), at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()))
                 for at in range(0, len(ids), 1024)]
    assert pieces == sorted(want)
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    return sum(packing.slack(s[-1][1], 1024) for s in spans.values()) / max(1, sum(r["length"] for r in got))


def test_pack_edges(spark):
    path, rows = P.path("byte_bpe_50k.json"), edge_rows()
    check_packed(rows, packing.pack_documents(docs(spark, rows), path), path)
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    with_ids = packing.pack_documents(docs(spark, rows), path, with_ids=True)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in with_ids.collect())


def test_op7_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    padding = check_packed(rows, QUERIES["op7_packing"](spark, "/root/testdata/sf0.01"), P.path("byte_bpe_50k.json"))
    assert padding < 0.01


# wavelet shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49_000), max_size=300) | st.lists(st.integers(0, 3), max_size=1200))
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    built = wavelet.WaveletMatrix.build(a)
    m = wavelet.WaveletMatrix.of({"n_tokens": len(a)} | built.columns())
    assert m.all().tolist() == ids
    if ids:
        assert m.access(np.arange(len(a))).tolist() == ids
    for token in {*ids[:4], 7}:
        where = [i for i, x in enumerate(ids) if x == token]
        assert m.rank(token) == len(where) and m.occurrences(token) == where
        assert m.rank(token, len(ids) // 2) == sum(x == token for x in ids[: len(ids) // 2])
        assert m.select(token, len(where)) is None


def check_files(rows, df):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_files_edges(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    rows, path = edge_rows(), P.path("word_bpe_49k.json")
    check_files(rows, wavelet.token_files(docs(spark, rows), path, 2))
    assert wavelet.token_files(docs(spark, []), path, 2).count() == 0


def test_op10_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    check_files(rows, QUERIES["op10_wavelet_shards"](spark, "/root/testdata/sf0.01"))
