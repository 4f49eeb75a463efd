"""Chains in time: a row is taken when enough time has passed since the last taken one, not since the row before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stands for a missing time: before all others.
_NEVER = np.iinfo(np.int64).min


def taken(at: np.ndarray, force: np.ndarray, last: int, gap: int) -> tuple[np.ndarray, int]:
    """(mask of the rows taken, time of the last taken one) of rows whose times ascend from each forced row to the next.
    Jumps from taken row to taken row, by binary search."""
    keep = force.copy()
    edges = [0, *np.flatnonzero(force).tolist(), len(at)]
    for a, b in zip(edges[:-1], edges[1:]):
        i = a
        if i < b and force[i]:
            last, i = int(at[i]), i + 1
        while i < b:
            i += int(np.searchsorted(at[i:b], last + gap))
            if i < b:
                keep[i], last, i = True, int(at[i]), i + 1
    return keep, last


def greedy_chain(rows: DataFrame, key: list[str], order: list[Column | str], time: str, hours: float, forced: str) -> DataFrame:
    """The rows of each key that are taken, in order: the first one, those where the boolean column forced holds, and each that
    lies at least so many hours after the last one taken. Order begins with time; rows without time come first.

    A fold over sorted rows: one shuffle, and a task holds a batch and one time, whatever the length of a series. The mark
    of a key's first row comes from the window that sorts them, so the batches need no keys.
    """
    w = W.partitionBy(*key).orderBy(*order)
    marked = rows.withColumns({"_first": F.row_number().over(w) == 1, "_at": F.unix_micros(F.col(time).cast("timestamp"))})
    gap = int(hours * 3_600_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _NEVER
        for batch in batches:
            at = np.asarray(pc.fill_null(batch.column("_at"), int(_NEVER)))
            force = np.asarray(pc.or_(batch.column("_first"), pc.fill_null(batch.column(forced), False)).to_numpy(zero_copy_only=False))
            keep, last = taken(at, force, last, gap)
            yield batch.filter(pa.array(keep))

    # the window has sorted the rows already: no second sort is planned
    return marked.sortWithinPartitions(*key, *order).mapInArrow(fold, marked.schema).select(*rows.columns)
