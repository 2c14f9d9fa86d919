"""Side-by-side check of a Spark query against its DuckDB oracle.

Row count, column names and an order-insensitive multiset of rows are
compared (doubles to 9 significant digits, timestamps as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if f != f:
            return "nan"
        return float(f"{f:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_multiset(cols: list[str], rows) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "same_columns": sorted(s_cols) == sorted(d_cols)}
    if not out["same_columns"]:
        out["spark_only"] = sorted(set(s_cols) - set(d_cols))
        out["oracle_only"] = sorted(set(d_cols) - set(s_cols))
        out["match"] = False
        return out
    a, b = rows_multiset(s_cols, s_rows), rows_multiset(d_cols, d_rows)
    out["match"] = a == b
    if not out["match"]:
        out["spark_extra"] = list((a - b).items())[:3]
        out["oracle_extra"] = list((b - a).items())[:3]
        out["columns"] = sorted(s_cols)
    return out
