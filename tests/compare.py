"""Rows of a Spark query and of its SQL in DuckDB, in comparable form."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in at], sorted(tuple(plain(r[k]) for k in at) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(sql, sf=SF, **views):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    for name, frame in views.items():
        con.execute(f"DROP VIEW {name}")
        con.register(name, frame)
    out = con.execute(sql)
    return rows_of([c[0] for c in out.description], out.fetchall())
