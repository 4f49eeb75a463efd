"""Filter interaction audit (11): signed parity sums of failure masks, inverted exactly by the Walsh-Hadamard transform, tell what each filter removes in each order."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import SPACE, materialize


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails a filter of its own: A few words, B few distinct words, C capitals, D marks. Null
    counts as empty. Words are runs of anything but white space."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE + "+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }


def _copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with copy: another row with a smaller id has the same digest.

    The smallest id of each digest is summed before the shuffle, then met by digest and id together, so that the rows of
    a text that very many share are dealt to all tasks. Rows without id are copies of nothing and nothing is a copy of them.
    """
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("first")


def _sign(both: Column) -> Column:
    """1 where the two masks share an even number of filters, else -1; both: the bits they share."""
    return (1 - 2 * F.pmod(F.bit_count(both), F.lit(2))).cast("long")


def parity_sums(masks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, parity array<long>): for each set S of filters, the sum over the rows of +1 where an even number of S failed and
    -1 where an odd number did. Summed before the shuffle: a key's rows, however many, leave each task as one."""
    return masks.groupBy(*keys).agg(F.array(*(F.sum(_sign(F.col("mask").bitwiseAND(F.lit(s)))) for s in range(size))).alias("parity"))


def mask_cells(parity: Column, size: int) -> Column:
    """The number of rows of each mask: the transform is its own inverse but for the factor size, so the division is exact."""
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    signed = lambda m: F.aggregate(masks, F.lit(0).cast("long"), lambda acc, s: acc + _sign(m.bitwiseAND(s)) * F.get(parity, s))
    return F.transform(masks, lambda m: (signed(m) / size).cast("long")) if size > 1 else parity


def _clear(cells: Column, size: int) -> Column:
    """For each set Q of filters, the number of rows that fail none of Q."""
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(masks, lambda q: F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(m.bitwiseAND(q) == 0, F.get(cells, m)).otherwise(F.lit(0).cast("long"))))


def _shapley(cells: Column, names: Sequence[str]) -> Column:
    """For each filter, its removals summed over all orders: a row that k filters fail is removed by each in 1 / k of the orders."""
    size, orders = 2 ** len(names), math.factorial(len(names))
    own = lambda i: [F.get(cells, F.lit(m)) * (orders // m.bit_count()) for m in range(size) if m >> i & 1]
    return F.array(*(sum(own(i)[1:], own(i)[0]) for i in range(len(names))))


def orders_of(names: Sequence[str]) -> Column:
    """An array with a struct for each order and step: order, step, the filter's number and bit, the mask of the filters before
    it. One constant, so that the plan stays small."""
    found = []
    for order in itertools.permutations(range(len(names))):
        text = "".join(names[i] for i in order)
        found += [{"filter_order": text, "step": k + 1, "own": i, "bit": 1 << i, "before": sum(1 << j for j in order[:k])} for k, i in enumerate(order)]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order: string, step: int, own: int, bit: int, before: int>>")


def filter_audit(masks: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What each filter removes at each step of each order, for each part of the rows (part, mask, good, toxic).

    Bit i of mask tells that the row fails filter i of names (one letter each; orders are all len(names)! permutations, so
    there should be few); good and toxic are booleans, null counts as false; rows of a null part form the part "". The
    rows leave the tasks as 2 ** len(names) sums for each part and label; all the rest is computed from these. Any number
    of parts may be had: each is a row. An empty table gives no rows; extra columns are ignored.

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    size = 2 ** len(names)
    labelled = masks.select(
        F.coalesce("part", F.lit("")).alias("part"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.col("mask").cast("int").alias("mask")
    )
    cells = parity_sums(labelled, ["part", "good", "toxic"], size).select("part", "good", "toxic", mask_cells(F.col("parity"), size).alias("cells"))

    def summed(of: Column) -> Column:
        return F.array(*(F.sum(F.when(of, F.get("cells", F.lit(m))).otherwise(F.lit(0).cast("long"))) for m in range(size)))

    parts = cells.groupBy("part").agg(summed(F.lit(True)).alias("cells"), summed(F.col("good")).alias("good"), summed(F.col("toxic")).alias("toxic"))
    clear = parts.select(
        "part", "cells", _shapley(F.col("cells"), names).alias("shapley"), *(_clear(F.col(c), size).alias(f"clear_{c}") for c in ("cells", "good", "toxic"))
    )
    steps = clear.withColumn("steps", F.explode(orders_of(names))).select("*", "steps.*")
    own = F.col("bit")
    after = F.col("before").bitwiseOR(own)
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    failing = F.get("clear_cells", F.lit(0)) - F.get("clear_cells", own)
    return steps.select(
        "part", "filter_order", "step", F.substring(F.lit(names), F.col("own") + 1, F.lit(1)).alias("filter"),
        F.get("clear_cells", after).alias("kept"), lost("clear_cells").alias("removed"), (failing - lost("clear_cells")).alias("redundant"),
        F.get("cells", own).alias("unique_fails"), lost("clear_good").alias("good_lost"), lost("clear_toxic").alias("toxic_lost"), F.get("shapley", F.col("own")).alias("shapley"),
    )


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every row: the filters A to D of text_failures, and E: a row with a smaller id has the same text.

    Texts are read once: masks and 256-bit digests are written to the shared folder. Rows that share an id and a text are
    no copies of one another. labels: (id, quality, toxic); where an id has several rows, one that says 1 is enough; ids
    without a row, and rows without id, are neither good nor toxic. Null texts are empty.
    """
    failures = list(text_failures(F.col(text_col)).values())
    mask = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(failures[1:], 1)), failures[0].cast("int"))
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.col(part_col).cast("string").alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    )
    said = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = _copies(materialize(read, "masks")).join(said, "doc_id", "left")
    return found.select("part", (F.col("mask") + F.col("copy").cast("int") * (1 << len(failures))).alias("mask"), "good", "toxic")
