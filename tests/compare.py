"""Results of two engines as comparable lists."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return int(x) if math.isfinite(x) and x == int(x) and abs(x) < 1e15 else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(found, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(query, sql: str, spark, sf: str) -> None:
    ours = query(spark, sf)
    theirs = duck(sf).sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.collect(), ours.columns) == rows(theirs.fetchall(), theirs.columns)
