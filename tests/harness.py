"""Runs registered queries next to their SQL twins and compares the rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry

ROOT = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def compare(spark, name: str, sf_dir: str, con=None) -> str:
    """Empty when equal, else what differs."""
    sql = entry.oracle_sql()[name]
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spark_s = time.time() - started
    started = time.time()
    rel = (con or duck(sf_dir)).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    duck_s = time.time() - started
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; only Spark {extra}; only SQL {lost}"
    print(f"{name}: {len(got)} rows equal, spark {spark_s:.1f}s, sql {duck_s:.1f}s", flush=True)
    return ""
