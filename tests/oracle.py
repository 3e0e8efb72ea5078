"""Compares a query with its SQL: column names, row count, and values as sorted text with doubles rounded."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} and {sorted(want_names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else None
