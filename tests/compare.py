"""Compare a Spark result with its SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    text = pdf.astype(object).where(pdf.notna(), None)
    text = text.map(lambda v: "<null>" if v is None else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows in any order, else a short account."""
    got, want = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} <> {list(want.columns)}"
    if len(got) != len(want):
        only = pd.concat([got, want]).drop_duplicates(keep=False).head(6).to_dict("records")
        return f"{len(got)} rows <> {len(want)}: {only}"
    bad = (got != want).any(axis=1)
    if bad.any():
        cols = [c for c in got.columns if (got[c] != want[c]).any()]
        return f"{int(bad.sum())} rows differ in {cols}: {got[bad][cols].head(3).to_dict('records')} <> {want[bad][cols].head(3).to_dict('records')}"
    return None
