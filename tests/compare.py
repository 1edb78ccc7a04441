"""Rows of Spark and of DuckDB made comparable: floats to nine digits, nested values as tuples."""

import collections
import datetime
import decimal
import os


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def bag(rows):
    return collections.Counter(tuple(plain(v) for v in r) for r in rows)


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    want = bag(tuple(r[i] for i in place) for r in got.fetchall())
    have = bag(df.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
