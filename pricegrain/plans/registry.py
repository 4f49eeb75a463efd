"""Queries register here, each with the SQL that a second engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        own = name or f.__name__
        if own in QUERIES:
            raise ValueError(f"{own} is registered twice")
        QUERIES[own] = f
        if sql:
            ORACLE[own] = sql
        return f

    return add
