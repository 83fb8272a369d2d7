"""Local stand-in for the driver's correctness gate: run a Spark query and its
DuckDB oracle on the same parquet tables and compare rows, schema and values
(order-insensitive, columns sorted by name, floats rounded)."""

from __future__ import annotations

import math

import duckdb

from dhvani.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, nd=6):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, nd) + 0.0
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):  # Decimal
        return round(float(v), nd) + 0.0
    return v


def run_both(spark, sf_dir, df, sql, con=None):
    con = con or duck(sf_dir)
    cols = sorted(df.columns)
    s_rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    d_raw = cur.fetchall()
    idx = [dcols.index(c) if c in dcols else None for c in cols]
    missing = [c for c, i in zip(cols, idx) if i is None]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in d_raw] if not missing else []
    return cols, dcols, s_rows, d_rows, missing


def compare(spark, sf_dir, df, sql, con=None):
    cols, dcols, s_rows, d_rows, missing = run_both(spark, sf_dir, df, sql, con)
    if missing or sorted(cols) != sorted(dcols):
        return False, f"columns differ: spark={cols} duck={sorted(dcols)}"
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(s_rows, key=key), sorted(d_rows, key=key)
    if len(a) != len(b):
        return False, f"row counts differ: spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row: spark={x} duck={y}"
    return True, f"{len(a)} rows match"
