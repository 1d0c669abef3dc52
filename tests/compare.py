"""Spark queries against their SQL in DuckDB, on the smallest test tables."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

ROOT = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (date, datetime)):
        return str(v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(ROOT):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{ROOT}/{f}'")
    got = query(spark, ROOT)
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cur.fetchall())
