"""Compare a Spark query with its DuckDB oracle: row count, column names, order-insensitive values."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_value(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return "|".join(sorted(str(_norm_value(x)) for x in v))
    return v


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm_value(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), h


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    s_n, s_h = digest(s_cols, s_rows)
    d_n, d_h = digest(d_cols, d_rows)
    return {"rows": (s_n, d_n), "cols_ok": sorted(s_cols) == sorted(d_cols), "cols": (s_cols, d_cols),
            "match": s_n == d_n and s_h == d_h and sorted(s_cols) == sorted(d_cols),
            "spark_sample": sorted(s_rows, key=repr)[:3], "duck_sample": sorted(d_rows, key=repr)[:3]}
