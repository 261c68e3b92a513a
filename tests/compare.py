"""Runs a query and its SQL on the same tables and compares rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        q = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{q}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return [norm(x) for x in v] if isinstance(v, list) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def check(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (name, df.columns, rel.columns)
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (name, len(bad), bad[:2])
