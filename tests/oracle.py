"""Run a registered query next to its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short text."""
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: {sc} != {dc}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} != {len(dr)}; first {sr[:2]} / {dr[:2]}"
    if not sr:
        return "both results are empty"
    diff = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(diff)} of {len(sr)} rows differ, e.g. {diff[:2]}" if diff else None
