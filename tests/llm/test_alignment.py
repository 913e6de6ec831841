"""Token alignment against the libraries' whole-text tokens, grouped byte by byte."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from frames import docs, edge_rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotewright.llm import alignment
from quotewright.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "ß", "...", ".", ",", "\t", "\x1c", "　", "\xa0", "don't", "日本語", "語",
          "😀", "🙂👍🏽", "\r\n", "İ", "́", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " Été", " w.\n", "Ａ", "▁", "\x00", "aaaaaaa", "s>", "k>", "\n", "\nThe", "x.\nY", "):", "5%", "a|b", "\n\n", "ÿ.", "a;\n"]
texts = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20)


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in shown} | {chr(0x100 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
        with open(A, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.bytes_a = {n: bytes(byte[c] for c in name) for name, n in vocab.items() if all(c in byte for c in name)}

    def bytes_b(self, n):
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """[(a ids, b ids)] of each group."""
        whole = b" " + (text or "").encode()
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.bytes_a[n] for n in a], [self.bytes_b(n) for n in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                out[-1][0].append(a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                out[-1][1].append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                out.append(([], []))
        return out[:-1]

    def rows(self, rows):
        found = [self.groups(t) for _, t in rows]
        count = Counter(pair for groups in found for pair in {(x, y) for g in groups for x in g[0] for y in g[1]})
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        out = []
        for (i, _), groups in zip(rows, found):
            links = [(x, y) for g in groups for x in g[0] for y in g[1]]
            text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
            out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                        sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    with open(A, "rb") as spec, open(B, "rb") as model:
        return alignment.PairAligner(spec.read(), model.read())


def check_texts(plain, aligner, some):
    numbers, listed, pairs, links, sizes = aligner.align(some)
    ends = np.cumsum(sizes).tolist()
    for at, text in enumerate(some):
        groups = plain.groups(text)
        want = Counter(x << 32 | y for g in groups for x in g[0] for y in g[1])
        part = slice(ends[at] - int(sizes[at]), ends[at])
        assert listed[at] == ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        assert numbers[at].tolist() == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), want.total()]
        assert dict(zip(pairs[part].tolist(), links[part].tolist())) == dict(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_texts(plain, aligner, some):
    check_texts(plain, aligner, some)


def test_many_texts(plain, aligner):
    draw = random.Random(5)
    some = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(14))) for _ in range(4000)]
    check_texts(plain, aligner, some + [r["text"] for r in table("documents")[:100]])


def test_texts_whose_tokens_differ(plain, aligner):
    numbers, listed, pairs, _, sizes = aligner.align(["a▁b c", None, "", "a \U0001f9ec z"])
    assert numbers[:3].tolist() == [[0] * 4] * 3 and listed[:3] == [""] * 3 and sizes[:3].tolist() == [0] * 3
    assert numbers[3, 2] > 1 and len(pairs) == sizes[3]


def test_memory_is_bounded(plain, aligner, monkeypatch):
    monkeypatch.setattr(alignment, "MOST", len(aligner.words) + 30)
    monkeypatch.setattr(alignment, "MANY", 2)
    draw = random.Random(9)
    for _ in range(30):
        some = ["".join(draw.choice(PIECES + [" x" * 60, "y" * 99]) for _ in range(draw.randrange(14))) for _ in range(40)]
        check_texts(plain, aligner, some)
        assert len(aligner.words) <= alignment.MOST and len(aligner.groups) == aligner.sums.size == len(aligner.words)
        assert aligner.pairs.size == aligner.sums.held[:, 6].sum()


def of(df):
    return sorted(map(tuple, df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_edges(spark, plain, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # all counts joined, some of them, none
    rows = edge_rows() + [(20, "tie a"), (21, "▁"), (22, "日本語 😀 <|endoftext|> <s>")]
    got = alignment.align_corpus(docs(spark, rows), A, B, digest=True).withColumnRenamed("groups", "groups_sha256")
    assert of(got) == plain.rows(rows)


def test_empty_table(spark):
    assert alignment.align_corpus(docs(spark, []), A, B).count() == 0
    assert alignment.align_corpus(docs(spark, [(1, None)]), A, B).first().n_a == 0


def test_op12_query(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", "/root/testdata/sf0.001")]
    assert of(QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001")) == plain.rows(rows)
