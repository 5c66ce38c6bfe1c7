"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{round(f, 6) + 0.0:g}" if f == int(f) and abs(f) < 1e5 else f"{f:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, int):
        return plain(float(v)) if abs(v) < 2**53 else str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, c, sql) -> str:
    """Empty if the query and the SQL agree."""
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall())
    if ours == theirs:
        return ""
    a, b = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only here {a}; only there {b}; columns {sorted(names)}"
