"""Spark's rows against DuckDB's over the same tables."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of_sql(sf, sql):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return sorted(r.columns), sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())


def rows_of_frame(df):
    c = sorted(df.columns)
    return c, sorted(repr(tuple(plain(r[x]) for x in c)) for r in df.collect())
