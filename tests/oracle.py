"""Run a query and its SQL counterpart and compare rows without regard to order."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([_norm(r[i]) for i in order] for r in rows), key=repr)


def compare(con, sql: str, df) -> str | None:
    """None when equal, else what differs. Values must be equal, not close."""
    names, rows = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    o_names, o_rows = _sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if names != o_names:
        return f"columns {names} against {o_names}"
    if len(rows) != len(o_rows):
        return f"{len(rows)} rows against {len(o_rows)}"
    bad = [(a, b) for a, b in zip(rows, o_rows) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(rows)} rows differ, first: {bad[0]}" if bad else None
