"""Document fingerprints (12): bottom-k sketches of the hashes of five-word shingles, which merge, and tell resemblance, containment and distinct count."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.chunks import in_batches
from pricegrain.llm.common import id_type, materialize
from pricegrain.llm.near_dedup import BATCH, shingle_sets

#: Hashes of a sketch. The standard error of a resemblance of 1/2 is about 1 / (2 * sqrt(k)); sets of at most k shingles are exact.
K = 256
#: Sketches a task of merged_sketches holds before it hands on what it has.
HELD = 10_000
_U = np.uint64


def sketches_of(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending; all of them where there are fewer."""
    out = []
    for _, own in in_batches(texts, BATCH):
        out += [s[:k].copy() for s in shingle_sets(own)]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets, from their sketches."""
    return np.union1d(a, b)[:k]


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Of the k smallest of the union: how many there are, how many are of both sets, how many of the first."""
    union = merge(a, b, k)
    last = union[-1] if len(union) else _U(0)
    x, y = a[a <= last], b[b <= last]
    return len(union), len(np.intersect1d(x, y, assume_unique=True)), len(x)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of intersection / union: among the k smallest hashes of the union, the share that both have. Exact where
    the union has no more than k. Two empty sets are alike (1), an empty and another one are not (0)."""
    n, both, _ = _common(a, b, k)
    return both / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of intersection / first set. An empty set is contained in every set (1)."""
    _, both, own = _common(a, b, k)
    return both / own if own else float(not len(a))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles: the k-th smallest of n hashes lies near k / n of their range. Exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def _numbers(sketch: bytes | None) -> np.ndarray:
    return np.frombuffer(sketch or b"", dtype=_U)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """docs with sketch (binary: at most k hashes, ascending, unsigned little-endian 64-bit), in place of a column of that name.

    A text's shingles are of five words (runs of anything but white space, A-Z lower-cased); one of fewer words is one
    shingle, one without words (null too) has an empty sketch. No shuffle: rows of any number and texts of any length
    are hashed where they are read, BATCH characters at once but for single texts above it. Rows that share an id have
    a sketch each. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    @F.pandas_udf("binary")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for s in sketches_of(texts.tolist(), k)], dtype=object)

    return docs.withColumn("sketch", sketch(text))


def merged_sketches(sketched: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, sketch, n_distinct double): the sketch of all shingles of each group of rows, and the estimated number of distinct ones.

    Each task merges the sketches of the groups it reads (at most HELD groups at once) and hands on one a group, so a
    group's rows, however many, meet as few as there are tasks. Rows of a null group form one group; null sketches are
    empty. An empty table gives no rows.
    """
    own, sent, kind = id_type(sketched, by)

    def given(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"part": np.array(list(held), dtype=object), "sketch": [x.tobytes() for x in held.values()]})

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, s in zip(pdf["part"].tolist(), pdf["sketch"].tolist()):
                found = _numbers(s)
                held[key] = merge(held[key], found, k) if key in held else found[:k]
                if len(held) >= HELD:
                    yield given(held)
                    held = {}
        if held:
            yield given(held)

    def wholly(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.empty(0, dtype=_U)
        for s in pdf["sketch"]:
            found = merge(found, _numbers(s), k)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "sketch": [found.tobytes()], "n_distinct": [distinct_count(found, k)]})

    parts = sketched.select(own.alias("part"), "sketch").mapInPandas(partly, f"part {sent}, sketch binary")
    whole = parts.groupBy("part").applyInPandas(wholly, f"part {sent}, sketch binary, n_distinct double")
    return whole.select(F.col("part").cast(kind).alias(by), "sketch", "n_distinct")


def _measure(of: object, kind: str, k: int) -> Column:
    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(_numbers(x), _numbers(y), k) for x, y in zip(a, b)], dtype="float64")

    return measured


def likeness(a: str, b: str, k: int = K) -> Column:
    """Estimated resemblance of two columns of sketches."""
    return _measure(resemblance, "double", k)(a, b)


def contained(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the first column's shingles that the second has."""
    return _measure(containment, "double", k)(a, b)


def _ends(keys: DataFrame, n: int) -> list[tuple]:
    """The last key of each of n ranges of about as many rows, ascending: a row a range comes to the driver."""
    ranged = keys.repartitionByRange(n, "key")
    ends = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.max("key").alias("last"))
    return [tuple(r["last"]) for r in ends.orderBy("last").collect()]


def _range_of(key: Column, ends: Column, n: int) -> Column:
    """The number of ends below the key: first among every step-th one, then among the step that follow."""
    step = math.isqrt(n - 1) + 1
    coarse = F.slice(F.filter(ends, lambda _, i: F.pmod(i + 1, F.lit(step)) == 0), 1, step)
    whole = F.size(F.filter(coarse, lambda e: e < key)) * step
    return whole + F.size(F.filter(F.slice(ends, whole + 1, F.lit(step)), lambda e: e < key))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Documents stand in descending order of id, rows without id last (ids are of a plain type, not structs); rows that share an id stand by the hash of their
    text (downwards; rows alike in both are interchangeable); after the last comes the first, so one row alone is its
    own next. The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of
    the next text, or all of that if it is shorter. Null texts are empty. An empty table gives no rows; columns other
    than id and text are ignored.

    The rows are dealt to ranges of ids, and the row at a range's lower end to the range below it too, so texts are
    shuffled once and each task streams through its range, holding two texts. The driver sees the ends of the ranges,
    one row for each shuffle partition.

    Returns id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own_id, sent, kind = id_type(docs, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    ends = materialize(docs.select(key.alias("key")), "keys")
    lasts = _ends(ends, n) or [(None, 0)]
    id_kind = docs.schema[id_col].dataType
    literals = F.array(*(F.struct(F.lit(i).cast(id_kind).alias("id"), F.lit(h).cast("long").alias("hash")) for i, h in lasts))
    placed = docs.select(own_id.alias("id"), text.alias("text"), key.alias("key")).withColumn("range", _range_of(F.col("key"), literals, len(lasts)))
    is_end = F.get(literals, F.col("range")) == F.col("key")
    here = F.struct(F.lit(1).alias("turn"), F.col("range"))
    there = F.struct(F.lit(0).alias("turn"), F.pmod(F.col("range") + 1, F.lit(len(lasts))).alias("range"))
    dealt = placed.withColumn("to", F.explode(F.when(is_end, F.array(here, there)).otherwise(F.array(here)))).select("id", "text", "key", "to.turn", "to.range")
    sorted_rows = dealt.repartitionById(len(lasts), "range").sortWithinPartitions("range", "turn", "key").select("turn", "id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, np.ndarray] | None = None
        for batch in batches:
            for start, texts in in_batches(batch.column("text").to_pylist(), BATCH):
                turns = batch.column("turn").slice(start, len(texts)).to_pylist()
                ids = batch.column("id").slice(start, len(texts))
                own = sketches_of(texts, k)
                follows, edited = [], []
                for t, turn, s in zip(texts, turns, own):
                    if turn:
                        half = len(t) // 2
                        edited.append(t[: len(t) - half] + before[0][:half])
                        follows.append(before[1])
                    before = (t, s)
                at = [i for i, turn in enumerate(turns) if turn]
                changed = sketches_of(edited, k)
                columns = {
                    "id": ids.take(pa.array(at, pa.int64())), "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    "sketch": pa.array([own[i].tobytes() for i in at], pa.binary()), "edited_sketch": pa.array([c.tobytes() for c in changed], pa.binary()),
                    "near_edited": pa.array([resemblance(own[i], c, k) for i, c in zip(at, changed)], pa.float64()),
                    "near_next": pa.array([resemblance(own[i], f, k) for i, f in zip(at, follows)], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    out = sorted_rows.mapInArrow(stream, f"id {sent}, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
