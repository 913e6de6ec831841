"""Prepare a corpus: drop poor documents and copies, find secrets, pack what is left into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.llm import exact_dedup, order_minhash, packing, quality, secrets
from quotewright.llm.common import prepare, table
from quotewright.operators.joins import fresh_keys
from quotewright.session import materialize

MASK = "[SECRET]"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3; learned from the labels of documents outside the held-out fold."""
    network = quality.learn(docs, table(spark, sf_dir, "labels"), fold_out=0, folds=5)
    return quality.keep_good(docs, network, threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near-duplicates.

    Rows are told apart by a key of their own, so that repeated and missing ids do no harm: rows of one id are
    compared with each other, and rows without an id take part and stay only if all of their class have none.
    """
    keyed = materialize(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = order_minhash.near_duplicates(keyed.select("_key", F.col("text").alias("_of")), "_key", "_of")
    members = found.select(F.col("doc_id").alias("_key"), "component_id").join(
        fresh_keys(keyed.select("_key", F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id")), ["_key"]), "_key")
    # a class of one keeps itself; kept rows are one for each class
    kept = members.groupBy("component_id").agg(F.min(F.struct("_none", "_id", "_key")).alias("_kept")).select(F.col("_kept._key").alias("_key"))
    dropped = materialize(members.select("_key").join(fresh_keys(kept, ["_key"]), "_key", "left_anti"), "near-copies")
    # by merge: the plan on a small corpus is that on a large one
    return keyed.join(fresh_keys(dropped, ["_key"]).hint("merge"), "_key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret and linked part of a credential in its text replaced by a mark."""
    return secrets.mask_secrets(docs, MASK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, end_id=0, capacity=1024)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: A convolutional network, an alignment and a tokenizer are not SQL: the tests hold ``run`` to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
