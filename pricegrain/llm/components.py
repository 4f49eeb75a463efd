"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach; nodes without edges don't appear.

    Large-star links each node's larger neighbours to the smallest of it and its neighbours, small-star its smaller ones
    and itself. The minimum of a node's neighbours is summed before the shuffle, and joined again, so that a node with
    very many edges is no single task's work. The edges of each round are written to the shared folder. The rounds end
    when neither step changes an edge, after about the logarithm of the nodes; not having ended by max_rounds is an error.
    """
    smaller = lambda df, x, y: df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct()
    now = materialize(smaller(edges, a, b), "edges")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        starred = materialize(smaller(large, "x", "y"), "edges")
        least = starred.groupBy("a").agg(F.min("b").alias("m"))
        small = starred.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        after = materialize(smaller(small, "x", "y"), "edges")
        state = _state(after)
        discard(starred)
        discard(now)
        now = after
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
