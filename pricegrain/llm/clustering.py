"""Centroid clustering (13): Lloyd's rounds by differences. Assignments and sums are kept; a round compares what moved and passes on signed transfers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import discard, materialize

#: Components beyond this in magnitude could make distances that do not fit in 64 bits.
LARGEST = 1 << 27
#: Rows compared at once.
SLICE = 4096


def whole_vectors(vectors: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    """The rows whose vector has exactly dims components, none null or non-finite, with vector array<long>: floor(scale * component)
    of each, taken as double."""
    vector = F.col(vector_col).cast("array<double>")
    sound = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(vector.isNotNull() & sound).withColumn("vector", F.transform(vector, lambda x: F.floor(x * scale).cast("long")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The vectors of the k rows with the smallest sha256 of "seed:id", in that order. Rows that share an id stand by their
    vectors; rows without id come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [tuple(r[0]) for r in rows.orderBy(order.asc_nulls_last(), "vector").select("vector").limit(k).collect()]


def _components(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return (d * d).sum(1)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance of each vector, from those of the round before (owner -1: none yet) and the numbers of the
    centroids that moved since. A vector whose owner stands still compares only those that moved, since it had been
    nearer (or as near, and first) to its owner than to all others; one whose owner moved compares all."""
    owner, distance = owner.copy(), distance.copy()
    astray = np.isin(owner, [-1, *moved])
    some = np.flatnonzero(~astray)
    for c in moved:
        d = _squared(x[some], centroids[c])
        won = (d < distance[some]) | ((d == distance[some]) & (c < owner[some]))
        owner[some[won]], distance[some[won]] = c, d[won]
    rest = np.flatnonzero(astray)
    if len(rest):
        best = np.full(len(rest), -1, dtype=owner.dtype)
        least = np.full(len(rest), np.iinfo(np.int64).max)
        for c in range(len(centroids)):
            d = _squared(x[rest], centroids[c])
            won = (d < least) | (best < 0)
            best[won], least[won] = c, d[won]
        owner[rest], distance[rest] = best, least
    return owner, distance


def _assigned(state: DataFrame, centroids: list[tuple[int, ...]], moved: list[int]) -> DataFrame:
    """state (row, vector, owner, was, distance, changed) after one assignment; was: the owner of the round before."""
    own, dims = np.array(centroids, dtype=np.int64), len(centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x = _components(part.column("vector"), dims)
                if x.max(initial=0) >= LARGEST or x.min(initial=0) <= -LARGEST:
                    raise ValueError(f"a component of {LARGEST} or more: distances would not fit in 64 bits")
                was = np.asarray(part.column("owner"))
                owner, distance = nearest(x, was, np.asarray(part.column("distance")), own, moved)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(owner), pa.array(was), pa.array(distance), pa.array(owner != was)], names=["id", "vector", "owner", "was", "distance", "changed"])

    kind = state.schema["id"].dataType.simpleString()
    return state.select("id", "vector", "owner", "distance").mapInArrow(assign, f"id {kind}, vector array<bigint>, owner int, was int, distance bigint, changed boolean")


def _transfers(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster, the signed number of vectors and the signed sums that it has gained in the last assignment: the vectors that
    changed count for their new owner and against their old one. Tasks hand on sums; the driver gets one row for each cluster
    and dimension at most."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _components(batch.column("vector"), dims)
            for sign, name in ((1, "owner"), (-1, "was")):
                side = np.asarray(batch.column(name))
                for c in np.unique(side[side >= 0]).tolist():
                    own = x[side == c]
                    found = sign * np.append(own.sum(0), len(own))
                    # Python's integers: a task's sums fit in 64 bits for 2**36 vectors, theirs together need not
                    total[c] = total[c] + found if c in total else found
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["cluster", "dim", "gained"])

    moved = state.filter("changed").select("vector", "owner", "was").mapInArrow(signed, "cluster int, dim int, gained bigint")
    found: dict[int, tuple[int, list[int]]] = {}
    rows: dict[tuple[int, int], int] = {(r[0], r[1]): int(r[2]) for r in moved.groupBy("cluster", "dim").agg(F.sum(F.col("gained").cast("decimal(38,0)"))).collect()}
    for c in {c for c, _ in rows}:
        found[c] = rows[c, dims], [rows[c, i] for i in range(dims)]
    return found


def delta_lloyd(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with a whole vector of dims finite components.

    Components become integers floor(scale * x), and all arithmetic is exact. The k rows with the smallest sha256 of
    "seed:id" are the first centroids. Each round assigns every vector to the nearest centroid (ties: the smaller number)
    and then moves each centroid that has vectors to their componentwise floor(sum / count); one without vectors stays.
    After the last round all are assigned once more. Fewer rows than k make fewer centroids; no row gives no rows.
    Equal vectors get the same cluster; rows that share an id, and rows without id, are rows of their own. Components of
    LARGEST / scale or more are an error, since distances would not fit in 64 bits. Other columns are ignored.

    Assignments are a table in the shared folder, written anew each round beside the vectors (a join with them would be a
    shuffle each round). Centroids and sums (k times dims numbers) are all the driver holds. A round in which no centroid
    moves would change nothing, nor would those after it, so it is left out.
    """
    kind = vectors.schema[id_col].dataType
    rows = whole_vectors(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v")), "_v", dims, scale)
    start = rows.select("id", "vector", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    state = materialize(start, "vectors")
    centroids = first_centroids(state, k, seed)
    columns = f"{id_col} {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], columns)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    moved = list(range(len(centroids)))
    for i in range(rounds + 1):
        after = materialize(_assigned(state, centroids, moved), "assigned")
        discard(state)
        state = after
        if i == rounds:
            break
        for c, (n, gained) in _transfers(state, dims).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], gained)]
        new = [tuple(s // counts[c] for s in sums[c]) if counts[c] else centroids[c] for c in range(len(centroids))]
        moved = [c for c in range(len(centroids)) if new[c] != centroids[c]]
        centroids = new
        if not moved:
            break
    inertia = {r[0]: int(r[1]) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values: F.get(F.array(*values), F.col("owner"))
    return state.select(
        F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance",
        by_cluster([F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )
