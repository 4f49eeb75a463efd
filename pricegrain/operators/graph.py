"""Components of edges that decisions and scores make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.operators.storage import discard, written


def min_labels(edges: DataFrame, a: str = "a", b: str = "b", most: int = 50) -> DataFrame:
    """(node, component): the smallest node of each component. Labels go along the edges and then jump to their label's
    label, so the rounds are about the logarithm of the longest path; each round is written to the shared folder and
    the one before it deleted."""
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(most):
        heard = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        moved = labels.join(heard, "u").select("u", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        up = moved.select(F.col("u").alias("label"), F.col("label").alias("up"))
        now = written(moved.join(up, "label", "left").select("u", F.coalesce(F.least("label", "up"), F.col("label")).alias("label"), "was"), "labels")
        done = now.filter("label <> was").isEmpty()
        discard(labels)
        if done:
            discard(both)
            return now.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = now
    raise RuntimeError(f"labels did not settle in {most} rounds")
