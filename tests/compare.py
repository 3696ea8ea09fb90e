"""Spark results against the same SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def same_rows(frame, con, sql: str) -> list[str]:
    """What differs; nothing if all is equal."""
    result = con.sql(sql)
    names = list(result.columns)
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} and {sorted(names)}"]
    order = sorted(names)
    spark_rows = sorted((tuple(_plain(row[c]) for c in order) for row in frame.collect()), key=str)
    duck_rows = sorted((tuple(_plain(row[names.index(c)]) for c in order) for row in result.fetchall()), key=str)
    if spark_rows == duck_rows:
        return []
    off = set(map(str, spark_rows)) ^ set(map(str, duck_rows))
    return [f"{len(spark_rows)} and {len(duck_rows)} rows, {len(off)} differ: {sorted(off)[:4]}"]
