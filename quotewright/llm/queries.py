"""One query per operator, over its whole table, and the same answer in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, bpe, decontaminate, langid, multi_index, order_minhash, packing, quality, secrets, url_filter, variants,
    wavelet,
)
from .common import prepare, table
from .exact_dedup import exact_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, end_id=0, capacity=1024)


@query
def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return wavelet.token_files(table(spark, sf_dir, "documents"), path, end_id=2)


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES, model)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_list", 256).alias("base_sha256"), F.col("span_list").alias("spans"))


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality.learn(docs, labels, fold_out=0, folds=5)
    scored = quality.score_quality(docs, network, threshold=0.3)
    held_out = F.coalesce(quality.fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, fold_out=1, folds=3))
    held_out = F.coalesce(quality.fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), least_length=7, least_count=2, misspell=31)
    return variants.spelling_variants(words, ratio=10)


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_corpus(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed(
        "groups", "groups_sha256")


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    automata = decontaminate.build_automata(table(spark, sf_dir, "benchmark"), window=10)
    marked = decontaminate.mark_documents(table(spark, sf_dir, "documents"), automata, keep=["doc_id"])
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """The same search and links in SQL; the pattern engine there has no look-around, so long runs are filtered."""
    found, kinds = [], []
    for rank, (kind, pattern, role, weak) in enumerate(secrets.KINDS, 1):
        plain = "[A-Za-z0-9+/_=-]{20,}" if kind == "random" else pattern
        found.append(f"SELECT r, {rank} AS rank, regexp_extract_all(t, {_sql_text(plain)}) AS m, "
                     f"string_split_regex(t, {_sql_text(plain)}) AS p FROM docs")
        kinds.append(f"({rank}, '{kind}', '{role}', {str(weak).lower()})")
    assign = _sql_text(secrets.KINDS[0][1])
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, role, weak) AS (VALUES {', '.join(kinds)}),
found AS ({' UNION ALL '.join(found)}),
steps AS (
  SELECT r, rank, unnest(m) AS m, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT r, rank, m, (sum(length(p)) OVER (PARTITION BY r, rank ORDER BY i)
    + sum(length(m)) OVER (PARTITION BY r, rank ORDER BY i) - length(m))::BIGINT AS a FROM steps),
spans AS (
  SELECT r, rank, kind, role, weak, a, a + length(m) AS e FROM placed JOIN kinds USING (rank)
  WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(m, {assign}, 2)) >= 6
    WHEN 'access' THEN length(m) >= 20
    WHEN 'random' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
    ELSE true END),
pairs AS (
  SELECT i.r, i.rank AS i_rank, i.a AS i_a, i.e AS i_e, s.rank AS s_rank, s.a AS s_a, s.e AS s_e, i.weak AND s.weak AS both_weak
  FROM spans i JOIN spans s ON i.r = s.r AND greatest(i.a - s.e, s.a - i.e) <= {secrets.SCOPE}
  WHERE i.role = 'identifier' AND s.role = 'secret'),
completed AS (
  SELECT q.*, n.rank AS n_rank, n.a AS n_a, n.e AS n_e
  FROM pairs q JOIN spans n ON q.r = n.r AND n.role = 'endpoint' AND greatest(q.i_a - n.e, n.a - q.i_e) <= {secrets.SCOPE}
  WHERE q.both_weak),
reported AS (
  SELECT r, i_rank AS rank, i_a AS a, i_e AS e FROM pairs WHERE NOT both_weak
  UNION SELECT r, s_rank, s_a, s_e FROM pairs WHERE NOT both_weak
  UNION SELECT r, i_rank, i_a, i_e FROM completed
  UNION SELECT r, s_rank, s_a, s_e FROM completed
  UNION SELECT r, n_rank, n_a, n_e FROM completed
  UNION SELECT n.r, n.rank, n.a, n.e FROM spans s JOIN spans n
    ON s.r = n.r AND s.role = 'secret' AND NOT s.weak AND n.role = 'endpoint' AND greatest(s.a - n.e, n.a - s.e) <= {secrets.SCOPE}),
listed AS (
  SELECT r, rank, kind, weak, a, e FROM spans WHERE NOT weak
  UNION ALL SELECT r, rank, kind, weak, a, e FROM reported JOIN kinds USING (rank) WHERE weak),
lists AS (
  SELECT r, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) FILTER (NOT weak) AS base,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) AS spans
  FROM listed GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (r)
"""


ORACLE["op6_secrets"] = _secrets_sql()
