import random
from collections import defaultdict

import numpy as np
import pytest
from frames import docs, edge_rows, table, words

from quotewright.llm import multi_index, order_minhash
from quotewright.llm.components import components
from quotewright.llm.queries import QUERIES


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# components


def test_components(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)]  # a chain
    links += [(500, 501 + i) for i in range(200)]  # a star
    links += [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(180)]
    links += [(b, a) for a, b in links[:50]] + [(7, 7)]
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == classes(nodes, [p for p in links if p[0] != p[1]])
    assert components(df.limit(0)).count() == 0


# Order MinHash


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def labelled(text):
    """Shingles of five words with their occurrence, written out."""
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    k = min(5, len(w))
    seen, out = defaultdict(int), []
    for i in range(len(w) - k + 1 if w else 0):
        s = tuple(w[i : i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def plain_similarity(a, b):
    a, b = labelled(a), labelled(b)
    common = lcs(a, b)
    return common / (len(a) + len(b) - common) if a and b else 0.0


def edited(text, share, seed):
    draw = random.Random(seed)
    out = []
    for w in text.split():
        x = draw.random()
        out += [] if x < share / 3 else [w, f"n{draw.random()}"] if x < 2 * share / 3 else [f"n{draw.random()}"] if x < share else [w]
    return " ".join(out)


def test_similarity_is_the_alignment():
    for seed in range(60):
        a = " ".join(words(120, seed, 30 if seed % 2 else 400))
        b = edited(a, [0.0, 0.02, 0.05, 0.2][seed % 4], seed)
        want = plain_similarity(a, b)
        got = order_minhash.similarity(order_minhash.shingles(a), order_minhash.shingles(b))
        assert got == pytest.approx(want) if want >= order_minhash.SIMILARITY else got < order_minhash.SIMILARITY


def test_order_counts():
    a = words(200, 9)
    swapped = a[100:] + a[:100]
    h, g = order_minhash.shingles(" ".join(a)), order_minhash.shingles(" ".join(swapped))
    assert len(np.intersect1d(h, g)) > 0.9 * len(h) and order_minhash.similarity(h, g) < 0.8


def test_shingles():
    assert len(order_minhash.shingles(None)) == len(order_minhash.shingles(" .,!")) == 0
    assert len(order_minhash.shingles("two words")) == 1
    assert (order_minhash.shingles("A b, c; D e f") == order_minhash.shingles("a B c d E f")).all()
    repeated = order_minhash.shingles("same " * 50)
    assert len(set(repeated.tolist())) == len(repeated) == 46


def corpus():
    rows = []
    for family in range(12):
        base = " ".join(words(150, family))
        rows += [(len(rows), base)] + [(len(rows) + 1 + i, edited(base, 0.01 * (i % 6), family * 100 + i)) for i in range(family)]
    hub = " ".join(words(300, 77))
    rows += [(1000 + i, edited(hub, 0.03, i)) for i in range(60)] + [(2000, hub)]
    passage = " ".join(words(60, 55))
    rows += [(3000 + i, " ".join(words(90, 4000 + i)) + " " + passage) for i in range(40)]
    return rows + [(4000, rows[0][1]), (4001, rows[0][1])]


def expected(rows):
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    texts = sorted(by_text)
    links = []
    for j, b in enumerate(texts):
        for a in texts[:j]:
            h, g = order_minhash.shingles(a), order_minhash.shingles(b)
            if order_minhash.similarity(h, g) >= order_minhash.SIMILARITY:
                links.append((by_text[a][0], by_text[b][0]))
    links += [(ids[0], i) for ids in by_text.values() for i in ids[1:]]
    return classes({i for i, _ in rows}, links)


def test_classes_like_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in order_minhash.near_duplicates(docs(spark, rows)).collect()}
    want = expected(rows)
    assert got == {i: (c, i == c) for i, c in want.items()}


def descendants(n, seed):
    """Texts of 200 words, each an edit of three words of a random earlier one: one family, mostly unlike each other."""
    draw = random.Random(seed)
    texts = [words(200, seed)]
    for i in range(1, n):
        texts.append(list(draw.choice(texts)))
        for at in draw.sample(range(200), 3):
            texts[-1][at] = f"e{i}x{at}"
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def plain_links(rows):
    """Brute force: the pairs of enough common shingles, counted for all pairs, aligned."""
    h = [order_minhash.shingles(t) for _, t in rows]
    _, column = np.unique(np.concatenate(h), return_inverse=True)
    at = np.repeat(np.arange(len(h)), [len(x) for x in h])
    there = np.zeros((len(h), column.max() + 1), np.float32)
    there[at, column] = 1
    n = there.sum(1)
    a, b = np.nonzero(np.triu(there @ there.T >= 0.79 / 1.79 * (n[:, None] + n), 1))
    return [(i, j) for i, j in zip(a.tolist(), b.tolist()) if order_minhash.similarity(h[i], h[j]) >= order_minhash.SIMILARITY]


def test_a_family_of_a_chain(spark):
    rows = descendants(3000, 5)
    links = plain_links(rows)
    want = classes(range(len(rows)), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in order_minhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(set(want.values())) == 1
    assert got == {i: (want[i], degree[i]) for i in want}


def test_near_edges(spark):
    rows = edge_rows()
    got = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}
    assert order_minhash.near_duplicates(docs(spark, [])).count() == 0


def test_op5_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", "/root/testdata/sf0.001")]
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op5_order_minhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == expected(rows)


# inverted multi-index


def vectors(seed=3, n=700, d=16):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, d))
    near = base[:60].repeat(4, axis=0) + draw.normal(size=(240, d)) * 0.08
    return np.concatenate([base, near, np.repeat(base[:1], 150, axis=0), base[5:6] * 3]).astype(np.float32)


def linked(v):
    unit = multi_index.unit_vectors(list(v))
    return unit @ unit.T >= multi_index.SIMILARITY


def test_vectors_like_brute_force(spark):
    v = vectors()
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    rows = {r["vec_id"]: r for r in multi_index.near_vectors(df).collect()}
    close = linked(v)
    true = close.sum(1) - 1
    got = np.array([rows[i]["n_links"] for i in range(len(v))])
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum()
    assert got[0] >= 150 and got[len(v) - 1] >= 1
    want = classes(range(len(v)), zip(*[x.tolist() for x in np.nonzero(np.triu(close, 1))]))
    same = sum(rows[i]["component_id"] == want[i] for i in range(len(v)))
    assert same >= 0.97 * len(v)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


def test_traversal_is_by_distance():
    sample = multi_index.unit_vectors(list(np.random.default_rng(1).normal(size=(300, 8))))
    index = multi_index.candidates(sample, 3000)[0]
    first, second = index.distances(sample)
    total = (first[:, :, None] + second[:, None, :]).reshape(len(sample), -1)
    visited = index.traverse(sample, 20)
    assert all(len(set(row)) == 20 for row in visited.tolist())
    assert np.allclose(np.take_along_axis(total, visited, 1), np.sort(total, 1)[:, :20])


def test_recall_in_a_hot_cluster():
    draw = np.random.default_rng(8)
    base = draw.normal(size=64)
    v = np.concatenate([draw.normal(size=(40_000, 64)), base + draw.normal(size=(20_000, 64)) * 0.15])
    unit = multi_index.unit_vectors(list(v))
    sample = unit[draw.permutation(len(unit))[: multi_index.SAMPLE]]
    for rows in (60_000, 200_000):
        index = multi_index.fit(sample, rows)
        a, b = unit[40_000:40_300], unit[50_000:50_300]
        close = a @ b.T >= multi_index.SIMILARITY
        there = (index.traverse(a)[:, None, :] == index.home(b)[None, :, None]).any(2)
        back = (index.traverse(b)[:, None, :] == index.home(a)[None, :, None]).any(2)
        assert close.mean() > 0.9 and (there | back.T)[close].mean() >= 0.97


def test_planted_pairs_among_many(spark):
    """Pairs just above the threshold, almost none of them in a sample."""
    draw = np.random.default_rng(9)
    v = draw.normal(size=(30_000, 64))
    across = draw.normal(size=(1000, 64))
    unit = v[:1000] / np.linalg.norm(v[:1000], axis=1, keepdims=True)
    across -= (across * unit).sum(1, keepdims=True) * unit
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    tight = draw.normal(size=64) + draw.normal(size=(100, 64)) * 0.01
    v = np.concatenate([v, 0.91 * unit + np.sqrt(1 - 0.91**2) * across, tight])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    rows = {r["vec_id"]: r for r in multi_index.near_vectors(df).collect()}
    assert sum(rows[i]["component_id"] == rows[30_000 + i]["component_id"] for i in range(1000)) >= 970
    assert all(rows[i]["n_links"] == 99 for i in range(31_000, 31_100))


def test_vectors_of_several_lengths(spark, monkeypatch):
    """An index for two of the lengths, one cell for each of the others, and a cluster in all of them."""
    monkeypatch.setattr(multi_index, "LARGE", 300)
    monkeypatch.setattr(multi_index, "SENT", 10)  # many cells, so that pairs meet in both homes
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    draw = np.random.default_rng(12)
    parts = []
    for d, n in ((8, 600), (12, 500), (3, 90), (5, 40)):
        center = draw.normal(size=d)
        parts.append(np.concatenate([draw.normal(size=(n, d)), center + draw.normal(size=(n // 3, d)) * 0.05]))
    ids, rows, want = 0, [], {}
    for v in parts:
        close = linked(v)
        for i, c in classes(range(len(v)), zip(*[x.tolist() for x in np.nonzero(np.triu(close, 1))])).items():
            want[ids + i] = (int(close[i].sum()) - 1, ids + c)
        rows += [(ids + i, x.tolist()) for i, x in enumerate(v)]
        ids += len(v)
    draw.shuffle(rows)
    df = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in rows], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df).collect()}
    assert all(got[i][0] <= n for i, (n, _) in want.items())  # no pair counts twice
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.97 * len(want)
    brute = range(len(parts[0]) + len(parts[1]), ids)
    assert all(got[i] == want[i] for i in brute)


def test_links_are_not_rows(spark, monkeypatch):
    """A meeting of blocks sends on a row for each vector, not one for each pair."""
    v = np.random.default_rng(2).normal(size=16) + np.random.default_rng(3).normal(size=(900, 16)) * 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    seen = []
    monkeypatch.setattr(multi_index, "_linked", lambda met, f=multi_index._linked: seen.append(f(met)) or seen[-1])
    rows = multi_index.near_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(899, 0)}
    assert seen[0].count() <= 2 * 900 * (900 // multi_index.BLOCK + 1)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (12, [5.0, 0.0, 1.0]), (13, [0.0, 0.0, 1.0]), (14, [3.0]), (15, [0.5]), (11, [-1.0, 0.0]), (11, [1.0, 0.05]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, component_id string")
    got = sorted(tuple(r) for r in multi_index.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 13)]
    others = [(10, 1, 10, True), (12, 1, 10, False), (14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted([*alone, *others, (7, 3, 7, True), (8, 3, 7, False), (9, 3, 7, False), (11, 0, 11, True), (11, 3, 7, False)])
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_op8_query(spark):
    rows = table("embeddings", "/root/testdata/sf0.1")
    close = linked([r["embedding"] for r in rows])
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op8_multi_index"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == len(rows) and sum(got.values()) >= 0.9 * (close.sum() - len(rows))
    assert all(got[r["vec_id"]] <= n - 1 for r, n in zip(rows, close.sum(1)))
