"""Run a registered query on Spark and its SQL text on DuckDB and compare whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def duck(d: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(d, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return ""
        return "%.9g" % (v + 0.0) if v else "0"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, text):
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_cols == want_cols, f"columns {got_cols} vs {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        raise AssertionError(f"{len(got)} vs {len(want)} rows\n only spark {sorted(a - b)[:4]}\n only sql {sorted(b - a)[:4]}")
    return len(got)
