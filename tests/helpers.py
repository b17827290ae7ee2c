"""Comparing a query with its SQL oracle in DuckDB."""

import glob
import os
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(spark, query, sql: str, folder: str = SMALL) -> None:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(map(str, r)) for r in df.select(*names).collect())
    found = tables(folder).execute(sql)
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    want = Counter(tuple(str(r[have.index(n)]) for n in names) for r in found.fetchall())
    assert got == want
