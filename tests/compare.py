"""Rows of a query against rows of its SQL, as unordered sets of rows."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def same_rows(got, want):
    """got, want: pandas frames."""
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    different = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or close(p, q) for p, q in zip(x, y))]
    assert not different, different[:3]


def close(p, q):
    try:
        return abs(float(p) - float(q)) <= 2e-6 * max(1.0, abs(float(q)))
    except ValueError:
        return False
