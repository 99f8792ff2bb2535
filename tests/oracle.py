"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def compare(spark, folder, query, sql, con):
    out = query(spark, folder)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(out.columns) == sorted(names)
    assert rows(out.columns, out.collect()) == rows(names, found.fetchall())
