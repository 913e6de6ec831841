"""Small hand-made tables for the operator tests."""

from __future__ import annotations

import os
import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, clashing=True):
    """Rows of (doc_id, text); further columns carry nulls and names the operators use themselves."""
    extra = ", keep_id string, score string, component_id int, _text string, a int, key string" if clashing else ""
    width = 3 + 6 * clashing
    return spark.createDataFrame([(i, t, *[None] * width) for i, t in rows], DOCS + extra)


def table(name, sf=SF):
    return pq.read_table(os.path.join(sf, f"{name}.parquet")).to_pylist()


def words(n, seed, size=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(size)}" for _ in range(n)]


def edge_rows():
    """Null, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(words(60_000, 1))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None),
            (6, long), (7, long), (8, "x" * 200_000), (9, "été Über 'tis don't 😀 \u0130stanbul"), (10, "\u3000 a\u0301 \xa0"),
            (11, "a <|endoftext|> b<|endoftext|>c")]
