"""Holds a query's rows against its SQL in DuckDB, on the driver's tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}" if f else "0"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(spark, query, sql: str, sf: str = SF) -> tuple[list, list]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    return got, sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
