"""A query against its DuckDB twin: equal column names and equal rows, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_rows, columns, con, sql):
    """What differs, in words; empty if nothing does."""
    rel = con.execute(sql)
    names, want = rows_of([x[0] for x in rel.description], rel.fetchall())
    mine, got = rows_of(columns, [tuple(r) for r in spark_rows])
    if names != mine:
        return f"columns {mine} against {names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows against {len(want)}; only Spark {sorted(a, key=repr)[:3]}; only SQL {sorted(b, key=repr)[:3]}"
    return ""
