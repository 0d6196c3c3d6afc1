"""Compares a query with its DuckDB oracle, whatever the order of rows and columns."""

from __future__ import annotations

import glob
import math

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return bool(value)
    if isinstance(value, (int, str)):
        return value
    try:
        return round(float(value), 5)
    except (TypeError, ValueError):
        return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    other = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(other):
        return f"{len(mine)} rows and {len(other)}; {list(set(mine) ^ set(other))[:4]}"
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None
