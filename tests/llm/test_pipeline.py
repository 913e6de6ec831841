import subprocess
import sys

import public_tokenizers as P
import pytest
from compare import connect, difference
from frames import SF, docs, edge_rows, words
from test_near_copies import expected as near_classes
from test_secrets import expected as secrets_of
from test_tokens import check_packed

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from quotewright.llm import quality
from quotewright.llm.queries import ORACLE, QUERIES
from quotewright.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in secrets_of(text)[4].split(",") if s]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + corpus_pipeline.MASK
        at = max(at, b)
    return out + text[at:] if spans else text


def plain_stages(rows, good):
    """Rows (doc_id, text) after each stage but the last, one by one."""
    rows = [r for r, score in zip(rows, good) if score >= 0.3]
    yield rows
    best = {}
    for i, t in rows:
        best[t] = max(i, best.get(t, i))
    rows = [(i, t) for i, t in rows if best[t] == i]
    yield rows
    root = near_classes(rows)
    rows = [(i, t) for i, t in rows if root[i] == i]
    yield rows
    yield [(i, masked(t)) for i, t in rows]


def test_stages_like_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    network = quality.learn(df, spark.read.parquet(f"{sf}/labels.parquet"))
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows, network.scores([t for _, t in rows]))):
        df = materialize(stage(spark, df, sf), "stage")
        assert df.columns == COLUMNS
        assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == sorted(want)
    check_packed(want, corpus_pipeline.STAGES[-1][1](spark, df, sf), P.path("byte_bpe_50k.json"))
    check_packed(want, corpus_pipeline.run(spark, sf), P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("place", range(5))
def test_stage_edges(spark, place):
    for rows in (edge_rows(), []):
        df = docs(spark, rows)
        out = corpus_pipeline.STAGES[place][1](spark, df, SF)
        found = out.collect()
        if place < 4:
            assert out.columns == df.columns
            assert {r["doc_id"] for r in found} <= {i for i, _ in rows}
        if place == 1:
            assert len(found) == len({t or "" for _, t in rows})
        elif place == 2:
            # one row of each text is left, that with the least id
            assert sorted(((r["doc_id"], r["text"] or "") for r in found), key=str) == sorted(least_ids(rows), key=str)
        elif place == 3:
            assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(rows, key=str)  # no secret here
        elif place == 4:
            check_packed(rows, out, P.path("byte_bpe_50k.json"))


def least_ids(rows):
    least = {}
    for i, t in rows:
        least.setdefault(t or "", []).append(i)
    return [(min((i for i in ids if i is not None), default=None), t) for t, ids in least.items()]


def test_near_copies_of_repeated_and_missing_ids(spark):
    text = " ".join(words(200, 3))
    near = text + " and one more"
    other = " ".join(words(180, 4))
    rows = [(1, text), (2, near), (2, other), (None, near), (3, other + " x"), (None, "alone " * 9)]
    out = corpus_pipeline.near_copies(spark, docs(spark, rows), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(1, text), (2, other), (None, "alone " * 9)], key=str)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_url_filter", "op6_secrets"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_entry_without_the_operators():
    code = ("import sys; sys.modules['quotewright.llm'] = None; sys.modules['corpus_pipeline'] = None; "
            "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 30")
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).returncode == 0
