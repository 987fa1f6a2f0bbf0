"""Holds a query's rows against its SQL run by DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def assert_same(df, sql, sf):
    got, want = rows_of(df), rows_of_sql(sql, sf)
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
