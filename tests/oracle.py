"""Runs a query and its SQL side by side."""

import glob
import math
import os

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def agree(df, c, sql):
    want = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
