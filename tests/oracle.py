"""Compares a query's rows with its DuckDB SQL on the same tables."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    try:
        return round(float(x), 9) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in data)


def difference(df, sql, con):
    """Empty if equal; else what differs."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only Spark: {list((got[1] - want[1]).elements())[:3]}; only SQL: {list((want[1] - got[1]).elements())[:3]}"
