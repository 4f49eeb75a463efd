"""Exact dedup (10): frequent digests found by Misra-Gries are settled by a broadcast, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.llm.common import SPACE, hot_keys, materialize


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts; of each group the row with the smallest id stays.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty, so null and
    empty texts form one group (a text of white space alone is one space and another group). Exactly one row of a group
    has kept: where several have the smallest id (they are alike in id and text), any one of them; a row without id only
    where none of the group has one, and then keep_id is null. Only id and text are read: other columns may have any names. An empty table gives no rows.

    Digests, not texts, are shuffled. Digests above the hot share are found with Misra-Gries, counted exactly (the
    count is summed before it is shuffled) and broadcast: at most 1 / share of them, whatever the size of the input.
    Returns id, keep_id, group_size, kept, text_sha256.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", " ")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    candidates = hot_keys(rows, "digest")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    winners = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(least.alias("least"), F.count("*").alias("group_size"))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    hot = marked.filter("least IS NOT NULL")
    group = W.partitionBy("digest")
    cold = (
        marked.filter("least IS NULL")
        .select("doc_id", "digest", "row")
        .withColumns({"least": least.over(group), "group_size": F.count("*").over(group)})
    )
    return hot.select("doc_id", "digest", "row", "least", "group_size").unionByName(cold.select("doc_id", "digest", "row", "least", "group_size")).select(
        F.col("doc_id").alias(id_col),
        F.col("least.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("least.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
