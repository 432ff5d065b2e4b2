"""Compare a Spark result with DuckDB's result of the query's SQL."""

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, values, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names, expected = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(names, expected, order)
