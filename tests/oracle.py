"""Compares a query with its SQL on the same tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import glob
import math

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else f"{v:.1f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, f, sql, d):
    df = f(spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    rows = rel.fetchall()
    assert sorted(names) == cols, (sorted(names), cols)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rows)
    types = {x[0]: str(x[1]) for x in rel.description}
    return got, want, dict(df.dtypes), types
