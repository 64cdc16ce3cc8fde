"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return round(float(x), 5) + 0.0
    if hasattr(x, "as_integer_ratio"):
        return round(float(x), 5) + 0.0
    if isinstance(x, (datetime, date)):
        return datetime(*x.timetuple()[:6]).isoformat() if isinstance(x, date) else x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
