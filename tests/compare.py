"""Run queries beside their SQL in DuckDB and compare rows."""

from __future__ import annotations

import glob
import numbers
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        path = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (float(v) + 0.0 if isinstance(v, numbers.Number) else v) for v in r))
    return sorted(rows, key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{name}: {len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{name}: {len(bad)} of {len(a)} rows differ, {bad[0]}" if bad else ""
