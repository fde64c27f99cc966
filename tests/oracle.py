"""Compares a query with its DuckDB statement over the same tables."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 9)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def holds(spark, query, sql):
    df = query(spark, SF)
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
