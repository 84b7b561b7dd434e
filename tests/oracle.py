"""Runs a registered query on Spark and its SQL on DuckDB and compares the results."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def sql_rows(con, sql: str):
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    rows = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    return columns, rows, dict(zip(rel.columns, [str(t) for t in rel.types]))


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, name, fn, sql, folder):
    """An empty string when everything agrees, else a short description."""
    df = fn(spark, folder)
    sc, sr = spark_rows(df)
    dc, dr, types = sql_rows(con, sql)
    if sc != dc:
        return f"columns {sorted(set(sc) ^ set(dc))}"
    wrong = [(c, k, types[c]) for c, k in df.dtypes if KINDS.get(k, k) != types[c]]
    if wrong:
        return f"types {wrong}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    if not sr:
        return "no rows"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ ({sc}), first {bad[0]}"
    return ""
