"""Functions for users who write SQL: register once for a session."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType

from pricegrain.functions import parse, similarity

#: name(parameters) and result of each function that is an expression, with its body.
EXPRESSIONS = {
    "pg_unit_price(price DOUBLE, units INT, confidence DOUBLE)": ("DOUBLE", "CASE WHEN units > 0 AND confidence >= 0.7 THEN price / units END"),
    "pg_discount_percent(best DOUBLE, worst DOUBLE)": ("DOUBLE", "coalesce(greatest(try_divide(nullif(worst, 0) - nullif(best, 0), nullif(worst, 0)) * 100, 0D), 0D)"),
    "pg_saving(best DOUBLE, other DOUBLE)": ("DOUBLE", "CASE WHEN best IS NOT NULL AND other > 0 THEN other - best END"),
    "pg_days_until(expiry TIMESTAMP, moment TIMESTAMP)": ("INT", "CAST(greatest(ceil((unix_timestamp(expiry) - unix_timestamp(moment)) / 86400), 0) AS INT)"),
}


class PageBlocks:
    """The JSON-LD objects of a page, laid flat: position, type, name, block (JSON)."""

    def eval(self, html: str) -> Iterator[tuple]:
        from pricegrain.sources.html import _flat, scripts_of

        n = 0
        for text in scripts_of(html):
            try:
                blocks = list(_flat(json.loads(text)))
            except ValueError:
                continue
            for b in blocks:
                yield n, _text(b.get("@type")), _text(b.get("name")), json.dumps(b)
                n += 1


class PageLinks:
    """The hits of a selector in a page: position, value (of an attribute, or the text if it is null)."""

    def eval(self, html: str, selector: str, attribute: str) -> Iterator[tuple]:
        from pricegrain.sources.html import hits_of

        yield from enumerate(hits_of(html, selector, attribute))


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


@pandas_udf(StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """E21 for SQL, which has no name for a Column expression; DataFrames use parse.absolute_url."""

    def join(b: str | None, h: str | None) -> str | None:
        h = (h or "").strip()
        return None if not h or h.startswith(("javascript:", "mailto:", "#")) else urljoin(b or "", h)

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


def register(spark: SparkSession) -> list[str]:
    """The names of the functions that SQL of this session may use from now on: expressions (which Spark plans as if they were
    written out), vectorised Python functions, and table functions."""
    names = []
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        names.append(head.partition("(")[0])
    for name, f in {"pg_absolute_url": absolute_url, "pg_unescape": parse.unescape, "pg_jaro_winkler": similarity.jaro_winkler, "pg_search_score": similarity.search_score}.items():
        spark.udf.register(name, f)
        names.append(name)
    for name, cls, kind in (("pg_page_blocks", PageBlocks, "position int, type string, name string, block string"), ("pg_page_links", PageLinks, "position int, value string")):
        spark.udtf.register(name, udtf(cls, returnType=kind))
        names.append(name)
    return names
