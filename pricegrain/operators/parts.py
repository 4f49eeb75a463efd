"""Stored tables in parts by a hash of the key, so that a run rewrites only the parts that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators.storage import upsert

PART = "_part"


def _part(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def create(df: DataFrame, path: str, keys: Sequence[str], n: int) -> None:
    """Write a table of n parts; what the parts are by lies beside them."""
    _part(df, keys, n).repartition(n, PART).write.partitionBy(PART).parquet(path)
    df.sparkSession.createDataFrame([(n, list(keys), df.schema.json())], "n int, keys array<string>, schema string").coalesce(1).write.parquet(f"{path}/_layout")


def _layout(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    n, keys = spark.read.parquet(f"{path}/_layout").select("n", "keys").first()
    return n, list(keys)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def _touched(spark: SparkSession, path: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """(the stored rows of the parts that rows have keys of, rows, number of parts, keys). Rows' keys get the stored types, on which
    the hash hangs. The numbers of the touched parts, n at most, are the filter that prunes the folders."""
    n, keys = _layout(spark, path)
    stored = spark.read.parquet(path)
    rows = rows.withColumns({k: F.col(k).cast(stored.schema[k].dataType) for k in keys})
    parts = [r[0] for r in _part(rows, keys, n).select(PART).distinct().collect()]
    return stored.filter(F.col(PART).isin(parts)).drop(PART), rows, n, keys


def _replace(df: DataFrame, path: str, keys: Sequence[str], n: int) -> None:
    # read from the parts that are replaced: the new files are written beside them and moved in when all are there
    _part(df, keys, n).repartition(n, PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def upsert_parts(spark: SparkSession, path: str, new: DataFrame, keep_old: Sequence[str] = (), keep_null: Sequence[str] = (), guard: Column | None = None) -> None:
    """Storage.upsert into a stored table. Parts without a key of new are neither read nor written. new has
    one row of a key; without rows nothing is written."""
    old, rows, n, keys = _touched(spark, path, new)
    _replace(upsert(old, rows, keys, keep_old, keep_null, guard), path, keys, n)


def remove_parts(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Without the rows whose keys are in gone. A part that loses all rows stays as it is on disk with them gone: it is
    written as an empty one."""
    old, rows, n, keys = _touched(spark, path, gone.select(*_layout(spark, path)[1]).distinct())
    marked = old.join(rows.withColumn("_gone", F.lit(True)), keys, "left")
    left = marked.filter("_gone IS NULL").select(old.columns)
    emptied = marked.filter("_gone").transform(lambda d: _part(d, keys, n)).select(PART).distinct().join(_part(left, keys, n).select(PART).distinct(), PART, "left_anti")
    lost = [r[0] for r in emptied.collect()]  # n at most
    _replace(left, path, keys, n)
    for part in lost:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={part}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
