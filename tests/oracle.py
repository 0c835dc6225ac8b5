"""Runs a query's SQL in DuckDB and compares it with Spark's rows."""

import glob
import math
import os

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return bytes(value) if isinstance(value, bytearray) else value


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def duck(sql, folder, types=False):
    """(sorted column names, sorted rows) of sql over the tables of a folder."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=key)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(v) for v in r) for r in df.select(*names).collect()), key=key)


def same(df, sql, folder):
    """Asserts that both have the same columns and rows."""
    (names, rows), (names2, rows2) = spark_rows(df), duck(sql, folder)
    assert names == names2
    assert len(rows) == len(rows2)
    for a, b in zip(rows, rows2):
        assert a == b, (names, a, b)
