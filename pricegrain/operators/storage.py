"""Tables written in place of long lineages, and upserts on Parquet, which has no MERGE."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on a cluster
    that would lose data, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pricegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Tables in the shared folder that were not deleted yet.
_WRITTEN: list[DataFrame] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again. The files go by discard, or when the driver's Python ends."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return temporary(df.sparkSession.read.schema(df.schema).parquet(path), path)


def temporary(found: DataFrame, path: str) -> DataFrame:
    """found, which reads a path of the shared folder whose files go as those of written tables do."""
    found._scratch = path
    if not _WRITTEN:
        atexit.register(_at_exit)
    _WRITTEN.append(found)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more, plans that are still to run included."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN[:] = [t for t in _WRITTEN if t is not df]


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        discard(*_WRITTEN)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), keep_null: Sequence[str] = (), guard: Column | None = None) -> DataFrame:
    """Rows of new are inserted or update those of old with their key; keys are compared null-safely.

    keep_old: columns that an update leaves as they were. keep_null: columns whose old value stays when the new one is
    null. guard: a condition on old's columns (aliased o) that a row must meet to be updated. new has one row of a key.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.withColumn("_old", F.lit(True)).alias("o").join(n, on, "full")
    fresh = F.col("n._new").isNotNull() & F.col("o._old").isNull()
    update = F.col("n._new").isNotNull() & (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))

    def value(c: str) -> Column:
        was = F.col(f"o.{c}")
        if c not in new.columns:
            return was
        now = F.col(f"n.{c}")
        if c in keys:
            return F.when(fresh, now).otherwise(was)
        changed = was if c in keep_old else F.coalesce(now, was) if c in keep_null else now
        return F.when(fresh, now).when(update, changed).otherwise(was)

    return joined.select(*(value(c).alias(c) for c in old.columns))


def newest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with a key, the one that is last by order."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key is not there yet; of several new ones, one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti").select(*old.columns))


def remove(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in gone."""
    return old.join(gone.select(*keys), list(keys), "left_anti")


def ordered_pair(a: str, b: str) -> tuple[Column, Column]:
    """A pair's key, whichever way round it is given."""
    return F.least(a, b), F.greatest(a, b)


def count_views(views: DataFrame, key: str, at: str) -> DataFrame:
    """Views are appended and counted, not incremented."""
    return views.groupBy(key).agg(F.count("*").alias("views"), F.max(at).alias("last_view"))


def counted_upsert(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """A counter upsert in one step: counts of old and new are added."""
    return old.select(key, count).unionByName(new.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def extend_term(now: Column, expiry: Column, active: Column, days: Column) -> Column:
    """An active term goes on from its end, any other from now."""
    start = F.when(active & (expiry > now), expiry).otherwise(now)
    return F.timestamp_add("DAY", days, start)


def delete_cascade(gone: DataFrame, key: str, tables: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose named column refers to a key that is gone; rows that refer to none stay."""
    return {name: rows.join(gone.select(F.col(key).alias(column)), column, "left_anti").select(rows.columns) for name, (rows, column) in tables.items()}
