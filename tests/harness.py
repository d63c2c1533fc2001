"""Runs a query and its checking SQL and compares rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def compare(spark, name: str, sf_dir: str, con=None) -> str:
    """'' if the results agree, else what differs."""
    import __spark_entry__ as e

    con = con or connect(sf_dir)
    df = e.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    rel = con.sql(e.oracle_sql()[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    want = [tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()]
    kinds = {c: t for c, t in df.dtypes}
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, kinds[c], theirs[c]) for c in cols if same.get(kinds[c], theirs[c]) != theirs[c]]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; types {odd}; first {sorted(got, key=repr)[:2]} {sorted(want, key=repr)[:2]}"
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}; types {odd}" if bad else f"types {odd}" if odd else ""
