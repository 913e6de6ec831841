import zlib

import numpy as np
import pytest
from frames import SF, docs, edge_rows, table

from quotewright.llm import langid, quality
from quotewright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def network(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return quality.learn(read("documents"), read("labels"))


def test_chunks_cover_whole_documents_and_overlap():
    texts = ["", None, "a" * 10, "b" * 5000, "é" * 700, "c" * quality.BLOCK]
    flat, first = quality.lay_out(texts)
    blocks = len(flat) // quality.BLOCK
    low, high, owner, starts = quality.chunks(first, blocks)
    assert set(low.tolist()) | set(high.tolist()) == set(range(blocks))
    for doc in range(len(texts)):
        own = list(zip(low[owner == doc].tolist(), high[owner == doc].tolist()))
        assert own[0][0] == first[doc] and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert starts[doc] == np.flatnonzero(owner == doc)[0]


def plain_score(net, text):
    """The network written out: every window of every chunk, one by one."""
    raw = bytes(quality.WIDTH - 1) + (text or "").encode()
    size = -(-len(raw) // quality.BLOCK) * quality.BLOCK
    padded = np.frombuffer(raw.ljust(size + quality.WIDTH, b"\0"), np.uint8)
    logits = []
    for at in range(0, max(size - quality.BLOCK, 1), quality.BLOCK):
        places = range(at, min(at + 2 * quality.BLOCK, size))
        seen = np.stack([net.embed[padded[p : p + quality.WIDTH]].ravel() @ net.filters for p in places])
        pooled = seen.max(axis=0) + net.bias
        logits.append(np.maximum(pooled @ net.layer + net.layer_bias, 0) @ net.out + net.out_bias[0])
    total = net.combine @ [max(logits), np.mean(logits), 1.0]
    return 1 / (1 + np.exp(total))


def test_scores_are_the_network(network):
    texts = ["", "one", None, *[r["text"][:3000] for r in table("documents")[:8]]]
    assert network.scores(texts) == pytest.approx([plain_score(network, t) for t in texts], abs=1e-4)


def test_a_defect_anywhere_counts(network):
    clean = next(r["text"] for r in table("documents") if len(r["text"]) > 8000 and "%%%" not in r["text"])
    junk = "".join(f"the{m} " for m in ("***", "$$$", "&&&", "%%%", "###") * 60)
    before, after = network.scores([clean, clean + junk])
    assert after < before


def test_quality_edges(spark, network):
    rows = edge_rows()
    got = quality.score_quality(docs(spark, rows), network).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == pytest.approx(by_id[2], abs=1e-4)
    assert quality.score_quality(docs(spark, []), network).count() == 0
    unknown = quality.score_quality(docs(spark, rows), None).collect()
    assert {(r["score"], r["predicted"]) for r in unknown} == {(0.5, 1)}
    kept = quality.keep_good(docs(spark, rows), network)
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])


def test_no_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.learn(docs(spark, edge_rows()), labels) is None


def labelled_frames(spark, rows):
    """Frames of documents and labels from (doc_id, text, label); a null text is a label without a document."""
    labels = spark.createDataFrame([(i, c, 0) for i, _, c in rows], "doc_id bigint, quality int, toxic int")
    return docs(spark, [(i, t) for i, t, _ in rows if t is not None]), labels


def test_learns_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 1000)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300)
    good, junk = " plain words of a text that reads well" * 900, " ### $$$ %%%% &&& *** ###" * 1200
    rows = [(i, (good if i % 2 else junk) + str(i), i % 2) for i in range(60)]
    network = quality.learn(*labelled_frames(spark, rows))
    scores = network.scores([good, junk, good[:500], junk[:500]])
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5 > scores[3]


def test_sample_is_bounded_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 50)
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    # one id with very many rows, copies and others, and labels without a document
    rows = [(7, f"copy {n % 3} " * 30, 1) for n in range(4000)] + [(7, f"other {n} " * 30, 1) for n in range(500)]
    rows += [(100 + n, f"text {n} " * 9, n % 2) for n in range(30)] + [(1000 + n, None, 0) for n in range(5000)]
    frames = labelled_frames(spark, rows)
    quality.learn(*frames)
    quality.learn(frames[0].repartition(7), frames[1].repartition(3))
    (texts, labels), again = seen
    assert again == (texts, labels) and labels.count(1) == 20 and labels.count(0) >= 8
    assert max(map(len, texts)) <= 50


def test_op3_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, sf).collect()}
    assert len(got) == len(table("documents", sf))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in table("labels", sf) if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert np.mean([b for a, b in held if a]) >= 0.99


# language


def test_forward_backward_is_exact():
    draw = np.random.default_rng(0)
    owner = np.repeat([0, 1, 2, 3, 4], [1, 5, 130, 64, 2])
    evidence, transitions = draw.normal(size=(202, 3)), draw.normal(size=(3, 3))
    got, pairs = langid.forward_backward(evidence, transitions, owner, pairs=True)
    step, expected = np.exp(transitions), np.zeros((3, 3))
    for chain in range(5):
        psi = np.exp(evidence[owner == chain])
        a, b = np.zeros_like(psi), np.ones_like(psi)
        a[0] = psi[0]
        for t in range(1, len(psi)):
            a[t] = a[t - 1] @ step * psi[t]
            a[t] /= a[t].sum()
        for t in range(len(psi) - 2, -1, -1):
            b[t] = step @ (psi[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        assert np.allclose(got[owner == chain], want)
        for t in range(1, len(psi)):
            joint = a[t - 1][:, None] * step * (psi[t] * b[t])
            expected += joint / joint.sum()
    assert np.allclose(pairs, expected)


@pytest.fixture(scope="module")
def field(spark):
    return langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_code_switched_words(field):
    rows = table("documents")
    pick = lambda lang: next(r["text"] for r in rows if r["lang"] == lang and 400 < len(r["text"]) < 2000)
    words = langid.Words.of([pick("en")[:400] + " " + pick("de")[:400]])
    label = [field.languages[i] for i in field.marginals(words).argmax(axis=1)]
    half = len(label) // 2
    assert label[: half - 15].count("en") > 0.9 * (half - 15) and label[half + 15 :].count("de") > 0.9 * (half - 15)


def test_batches_do_not_matter(field):
    texts = [r["text"] for r in table("documents")[:40]] + ["a", "I x", "", None, "...", "12 345", "é"]
    together, scores = field.predict(texts)
    alone = [field.predict([t]) for t in texts]
    assert together == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])
    assert together[-5:-1] == ["und"] * 4 and scores[-2] == 0 and together[-1] != "und"


def test_language_edges(spark, field):
    rows = edge_rows()
    got = langid.identify(docs(spark, rows), field).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == "und" and by_id[4] == by_id[5] != "und" and by_id[10] != "und"
    assert langid.identify(docs(spark, []), field).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, rows), None).collect()} == {"und"}
    assert langid.learn(docs(spark, rows)) is None


def plain_words(text):
    """(start, end) in the lower-cased bytes, and those bytes with all else blanked."""
    raw = (text or "").lower().encode()
    letters = [chr(b).isalpha() if b < 128 else True for b in raw]
    flat = bytes([32] * 3 + [b if on else 32 for b, on in zip(raw, letters)] + [32] * 3)
    edges = [at for at in range(1, len(flat)) if (flat[at] != 32) != (flat[at - 1] != 32)]
    return flat, list(zip(edges[::2], edges[1::2]))


def plain_marginals(field, text):
    """The field written out for one text: features of each word, then forward-backward word by word."""
    flat, words = plain_words(text)
    mask = len(field.grams) - 1

    def bucket(at, kind):
        code = flat[at] | flat[at + 1] << 8 | flat[at + 2] << 16
        return (((code ^ (kind * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF) >> 16) & mask

    evidence = np.zeros((len(words), len(field.languages)))
    for n, (start, end) in enumerate(words):
        for at in range(start - 1, end - 1):
            evidence[n] += field.grams[bucket(at, 1)]
        evidence[n] += field.affix[bucket(start, 2)] + field.affix[bucket(end - 3, 3)]
        h = 0
        for b in flat[start : min(end, start + 24)]:
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        h ^= (end - start) << 56 & (1 << 64) - 1
        known = np.flatnonzero(field.lexicon == np.uint64(h))
        if len(known):
            evidence[n] += field.member[known[0]] @ field.known
    psi, step = np.exp(evidence), np.exp(field.transitions.astype(float))
    a, b = psi.copy(), np.ones_like(psi)
    for t in range(len(psi)):
        if t:
            a[t] = a[t - 1] @ step * psi[t]
        a[t] /= a[t].sum()
    for t in range(len(psi) - 2, -1, -1):
        b[t] = step @ (psi[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return a * b / (a * b).sum(axis=1, keepdims=True)


def test_prediction_is_the_field(field):
    texts = [r["text"][:1500] for r in table("documents")[:25]] + ["a", "é b", "I x", "Straße und Über", "w " * 200, "x" * 90]
    found, scores = field.predict(texts)
    for text, lang, score in zip(texts, found, scores):
        p = plain_marginals(field, text).sum(axis=0)
        assert lang == field.languages[p.argmax()] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_spans_of_languages(spark, field):
    pick = lambda lang: next(r["text"] for r in table("documents") if r["lang"] == lang and 400 < len(r["text"]) < 2000)[:400]
    mixed = "\u0130 – " + pick("en") + " " + pick("de")
    rows = edge_rows() + [(30, mixed)]
    got = langid.language_spans(docs(spark, rows), field).collect()
    assert len(got) == len(rows)
    for row in got:
        text = next(t for i, t in rows if i == row["doc_id"] and (t or "") != "" or i == row["doc_id"])
        if row["doc_id"] is None:
            continue
        spans = row["spans"]
        assert all(a["end"] <= b["start"] and a["lang"] != b["lang"] for a, b in zip(spans, spans[1:]))
        assert all(0 < s["probability"] <= 1 and (text[s["start"]].isalpha() or text[s["start"]] > "~") and s["end"] <= len(text) for s in spans)
    (spans,) = [r["spans"] for r in got if r["doc_id"] == 30]
    held = lambda lang, part: sum(max(0, min(s["end"], part.stop) - max(s["start"], part.start)) for s in spans if s["lang"] == lang)
    assert held("en", range(4, 404)) > 320 and held("de", range(405, 805)) > 320
    # one label for each word of the plain version, merged
    p = plain_marginals(field, mixed)
    labels = [field.languages[i] for i in p.argmax(axis=1)]
    assert [s["lang"] for s in spans] == [x for n, x in enumerate(labels) if not n or labels[n - 1] != x]
    assert langid.language_spans(docs(spark, []), field).count() == 0
    assert all(r["spans"] == [] for r in langid.language_spans(docs(spark, rows), None).collect())


def test_more_languages_than_before(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    make = lambda n: " ".join(letters[n % 20] + letters[n // 20] + "aeiou"[k % 5] for k in range(60))
    rows = [(n * 10 + k, make(n), f"l{n:03d}", None, 0) for n in range(90) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    field = langid.learn(df)
    assert field.languages == [f"l{n:03d}" for n in range(90)] and field.grams.shape == (1 << 15, 90)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, field).collect()}
    assert sum(found[r[0]] == r[2] for r in rows) > 0.9 * len(rows)


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = table("documents", sf)
    got = {r["doc_id"]: r for r in QUERIES["op9_language"](spark, sf).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert np.mean(held) >= 0.99
