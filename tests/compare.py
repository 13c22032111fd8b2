"""A query's rows against those of its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def _cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NA or x != x:
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if math.isfinite(x) and x == int(x) else repr(round(x, 9))
    return "NULL" if str(x) in ("NaT", "<NA>") else str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False))


def check(spark, con, sf, query, sql):
    a, b = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
