"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return names, done.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(spark, query, sql, sf):
    names, want = rows_of_sql(sql, sf)
    got = query(spark, sf)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert len(a) == len(b)
    assert a == b
