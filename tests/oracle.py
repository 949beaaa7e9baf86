"""Run a registered query and its SQL and compare them as bags of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else round(float(v), 6)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, queries, oracles):
    """None when equal, else a short description of the difference."""
    df = queries[name](spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracles[name])
    columns = [d[0] for d in res.description]
    want = bag(columns, res.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        return (f"{sum(got.values())} rows vs {sum(want.values())}; only spark: "
                f"{list((got - want).items())[:2]}; only sql: {list((want - got).items())[:2]}")[:1800]
    if not want:
        return "both sides are empty"
    return None
