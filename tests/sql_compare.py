"""Runs a query and its SQL on the same tables and compares all rows."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in got), key=repr)


def assert_same(df, sql, con):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())
