"""Run a Spark query and its DuckDB oracle on the same tables and compare the results
order-insensitively (doubles to 1e-9 relative tolerance)."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", v)
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None))
    if v is None:
        return ("n", None)
    return ("v", v)


def _key(row):
    return tuple((k, "" if v is None else str(v)) for k, v in row)


def _close(a, b) -> bool:
    if a[0] == "f" and b[0] == "f":
        x, y = a[1], b[1]
        if math.isnan(x) and math.isnan(y):
            return True
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return a == b


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = list(spark_df.columns)
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_raw = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duckdb={d_cols}"
    order = [d_cols.index(c) for c in sorted(d_cols)]
    d_rows = [tuple(_norm(r[i]) for i in order) for r in d_raw]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duckdb={len(d_rows)}"
    s_sorted = sorted(s_rows, key=_key)
    d_sorted = sorted(d_rows, key=_key)
    for a, b in zip(s_sorted, d_sorted):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return False, f"value differs: spark={a} duckdb={b}"
    return True, f"{len(s_rows)} rows"
