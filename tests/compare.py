"""Rows of a Spark query against those of DuckDB."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return object() if math.isnan(v) else float(f"{float(v):.9g}")  # NaN equals nothing, as for the driver
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want, f"extra {list((got - want).items())[:3]}, lacking {list((want - got).items())[:3]}"
