"""Compare Spark results with DuckDB results, order-insensitively."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "is_integer") and not isinstance(v, (int, str)):
        return float(v)
    return v


def rows(columns, records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_cell(r[k]) for k in order) for r in records), key=repr)


def differences(spark_df, sql: str, con) -> list[str]:
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want = rows(want_cols, cursor.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    out = []
    if sorted(spark_df.columns) != sorted(want_cols):
        out.append(f"columns {sorted(spark_df.columns)} / {sorted(want_cols)}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}")
    return out
