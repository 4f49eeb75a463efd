"""Readers of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet", **options: object) -> DataFrame:
    """S3: Parquet, ORC, JSON or CSV; with a schema, files that don't fit it fail. options: the reader's own."""
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
        if kind in ("json", "csv"):
            reader = reader.option("mode", "FAILFAST")
    return reader.options(header=True, **options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8) -> DataFrame:
    """A database's table; with a key, in so many ranges of it at once."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def sql(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """Spark SQL with named parameters."""
    return spark.sql(text, args=args)


def deep_merge(base: dict, over: dict) -> dict:
    """Settings with overrides; tables inside are merged, anything else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def dotted(settings: dict, overrides: dict[str, object]) -> dict:
    """Overrides by dotted path, as the key-value table holds them."""
    for path, value in overrides.items():
        for part in reversed(path.split(".")):
            value = {part: value}
        settings = deep_merge(settings, value)
    return settings
