"""Tables out: rows for people, CSV and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.operators.market import unit_price
from pricegrain.operators.search import labelled


def export_rows(offers: DataFrame, stores: DataFrame, labels: Mapping[str, str], yes: str = "yes", no: str = "no") -> DataFrame:
    """Offers with shop, label of the stock, price of a unit, and whether the price is the product's best available one."""
    best = offers.filter("available").groupBy("product_id").agg(F.min("price").alias("_best"))
    joined = offers.join(best, "product_id", "left").join(stores.select("store_id", "store"), "store_id")
    return joined.select(
        "product_id", "name", "brand", "type", "store", "price", unit_price().alias("unit_price"), labelled("stock_status", labels).alias("stock"),
        F.when(F.col("price") == F.col("_best"), yes).otherwise(no).alias("is_best"), "seen_at",
    )


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Semicolons, a header, and the mark that tells spreadsheets the encoding, at the head of the first column's name."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("compression", compression).option("sep", ";").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_json(rows: DataFrame, path: str, compression: str = "none") -> None:
    """A line for each row."""
    rows.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", False).json(path)
