"""Exactly once from a stream to a folder: what a batch writes has the batch's name, so a batch that runs again writes it over."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators.storage import exists


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What publish_once has written so far, with the query and batch that wrote it."""
    full = f"{schema}, query string, batch long"
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


def publish_once(stream: DataFrame, key: str, ledger: str, outbox: str, state: str, send: Callable[[DataFrame, str], None] | None = None):
    """The stream's rows whose key the ledger does not hold go to the outbox, then their keys to the ledger.

    Each batch has a folder of its own in both, named by the query and the batch. A batch that failed anywhere is run again
    over the same input: it looks at what other batches entered, finds the same rows and overwrites its own folders, so the
    outbox and the ledger hold each key once. A query that begins anew, with another state folder, has another name and
    meets the ledger of all before it. send gets the rows as they lie in the outbox and the batch's name; whoever receives
    them outside must take two sendings of one name for one, as a sending cannot be undone.
    """
    kind = stream.schema[key].dataType.simpleString()

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        query = json.loads(spark.read.text(f"{state}/metadata").first()[0])["id"]
        own = f"query={query}/batch={number}"
        others = entries(spark, ledger, f"{key} {kind}").filter((F.col("query") != query) | (F.col("batch") != number)).select(key)
        rows.dropDuplicates([key]).join(others, key, "left_anti").select(rows.columns).write.mode("overwrite").parquet(f"{outbox}/{own}")
        out = spark.read.schema(rows.schema).parquet(f"{outbox}/{own}")
        if send is not None:
            send(out, own)
        out.select(key).write.mode("overwrite").parquet(f"{ledger}/{own}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True)
