"""Compares queries with their SQL in DuckDB: row count, columns and values."""

from __future__ import annotations

import datetime as dtm
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.9g}"))
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, dtm.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dtm.date):
        return value.isoformat()
    return value


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """NULL when equal, else what differs."""
    df = run(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = normal(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {sorted(columns)}: {bad[0][0]} != {bad[0][1]}"
    return None
