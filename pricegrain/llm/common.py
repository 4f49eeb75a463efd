"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder;
    on a cluster a folder of one machine would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pricegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables in the shared folder that were not deleted yet, oldest first.
_WRITTEN: list[DataFrame] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    if not _WRITTEN:
        atexit.register(_at_exit)
    _WRITTEN.append(found)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more, the returned DataFrame's plan included."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN[:] = [t for t in _WRITTEN if t is not df]


def marked() -> int:
    """A mark for free."""
    return len(_WRITTEN)


def free(mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was written since the mark, but for keep. An operator's result reads what the operator wrote, so this is
    for when the result has been used; what is left then goes when the driver's Python ends."""
    for df in _WRITTEN[mark:]:
        if df is not keep and df.sparkSession.sparkContext._jsc is not None:
            discard(df)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        free()


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, id_col: str) -> tuple[Column, str, str]:
    """(what goes to Python in place of the id, its type there, the id's type). Whole numbers go as text: a batch that
    holds a null would turn them into floating point."""
    kind = df.schema[id_col].dataType.simpleString()
    return (F.col(id_col), kind, kind) if kind.startswith("struct") else (F.col(id_col).cast("string"), "string", kind)


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hot_support(spark: SparkSession) -> float:
    """Share of all rows above which a key counts as hot: half of what a shuffle partition holds on average, but at least
    the 1e-4 that freqItems takes.

    It also bounds what is broadcast: at most 1 / support keys, 10,000 at the very most.
    """
    return max(1e-4, min(0.01, 1 / (2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def hot_keys(keys: DataFrame, key: str) -> DataFrame:
    """Misra-Gries (freqItems: Karp, Schenker, Papadimitriou): every key whose share exceeds the support, and some others; at most 1 / support rows."""
    frequent = keys.freqItems([key], hot_support(keys.sparkSession))
    return frequent.select(F.explode(f"{key}_freqItems").alias(key)).distinct()


def left_join_skewed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns, where right has one row a key at most. The rows of left's hot keys meet theirs in a
    broadcast of as many rows as there can be hot keys; the others are shuffled. left is read more than once."""
    others = [c for c in right.columns if c != key]
    flag = fresh("_hot", [*left.columns, *right.columns])
    keys = hot_keys(left.filter(F.col(key).isNotNull()), key)
    hot = keys.join(F.broadcast(right.join(F.broadcast(keys), key, "left_semi")), key, "left").withColumn(flag, F.lit(True))
    met = left.join(F.broadcast(hot), key, "left")
    at_once = met.filter(flag).select(*left.columns, *others)
    rest = met.filter(F.col(flag).isNull()).select(*left.columns).join(right, key, "left").select(*left.columns, *others)
    return at_once.unionByName(rest)
