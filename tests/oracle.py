"""Compares a Spark result with DuckDB's result of SQL over the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    return x


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.sql(sql)
    columns = found.columns
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
