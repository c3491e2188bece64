"""Compare registered queries with their DuckDB text: names, row count, order-free values."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from dialoscope.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else float(f"{f:.12g}")
    if isinstance(v, int):
        return float(v)
    return str(v)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(con, spark_df, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, left = _bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names2, right = _bag([d[0] for d in cur.description], cur.fetchall())
    if names != names2:
        return f"columns {names} != {names2}"
    if left != right:
        only_l, only_r = left - right, right - left
        return (f"rows {sum(left.values())} vs {sum(right.values())}; only Spark {list(only_l.items())[:3]}; "
                f"only oracle {list(only_r.items())[:3]}")
    return None
