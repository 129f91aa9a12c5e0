"""Row-by-row comparison of a Spark result with DuckDB's, as the driver does it."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        base = name.split(".")[0]
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, con) -> list:
    """Empty where Spark and DuckDB agree on column names and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    ours, theirs = bag([tuple(r) for r in df.collect()], df.columns), bag(result.fetchall(), names)
    return [*(("spark", *x) for x in list((ours - theirs).items())[:3]), *(("duckdb", *x) for x in list((theirs - ours).items())[:3])]
