"""Runs a query and its SQL side by side and tells how they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


def difference(spark, c: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str:
    """An empty text where names, number and values of rows are the same."""
    df = query(spark, folder)
    cursor = c.execute(sql)
    names = [x[0] for x in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, cursor.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, such as {wrong[0]}" if wrong else ""
