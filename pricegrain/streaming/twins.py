"""Structured Streaming forms of the change feed's consumers. The stored tables have no such thing: these are extensions.

Late rows: those older than the watermark are dropped by windows; the per-key states take rows as they come, in the order
of event time within a batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricegrain.operators.storage import exists, scratch

LATE = "1 hour"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time must be a timestamp with a zone for a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "30 minutes", late: str = LATE) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _ratchet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first value is the target; the state is (target, lowest price fired at). A null value never fires; as the first
    one it makes an alert without target, which never fires, as in the batch form."""
    seen = state.exists
    target, fired = state.get if seen else (None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for event_id, value in rows[["event_id", "value"]].itertuples(index=False):
        value = None if pd.isna(value) else value
        target, seen = (target if seen else value), True
        if value is not None and target is not None and value <= target and (fired is None or value < fired):
            fired = value
            out.append((key[0], event_id, value, target))
    state.update((target, fired))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "price", "target_price"])


def alerts(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(_ratchet, "user_id long, event_id long, price double, target_price double", "target double, fired double", "append", GroupStateTimeout.NoTimeout)


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state is what was last read of a page. A page without status (null) is unreadable; null prices tell no change."""
    before = state.get if state.exists else None
    out = []
    for event_id, http, stock, price in pd.concat(list(batches)).sort_values(["ts", "event_id"])[["event_id", "http_status", "stock_status", "price"]].itertuples(index=False):
        http, stock, price = (None if pd.isna(x) else x for x in (http, stock, price))
        can, there = stock in ("in_stock", "preorder"), http is not None and 1 <= http < 400
        if before is not None and there:
            could, gone = before[1] in ("in_stock", "preorder"), before[0] is None or not 1 <= before[0] < 400
            event = "published" if gone else "purchasable" if can and not could else "sold_out" if could and not can else None
            if event is None and price is not None and before[2] is not None and abs(price - before[2]) > 1:
                event = "price_up" if price > before[2] else "price_down"
            if event:
                out.append((key[0], event_id, event))
        before = (None if http is None else int(http), stock, None if price is None else float(price))
    state.update(before)
    yield pd.DataFrame(out, columns=["url", "event_id", "event"])


def watch(states: DataFrame) -> DataFrame:
    """states: url, event_id, ts, http_status, stock_status, price."""
    return states.groupBy("url").applyInPandasWithState(_watch, "url string, event_id long, event string", "http int, stock string, price double", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, tag: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote to the shared folder. Writing is exactly once, by the checkpoint."""
    spark = stream.sparkSession
    root = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def publish(stream: DataFrame, ledger: str, key: str, send, tag: str = "publish"):
    """Each batch's rows that the ledger does not hold yet are sent, then entered: at least once. A
    batch that is run again sends none twice that were entered; one that fails between sending and entering sends again
    (once.publish_once does not). The state's folder is named by tag and ledger, so streams of two ledgers share none."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates([key])
        if exists(spark, ledger):
            new = new.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        send(new)
        new.select(key).write.mode("append").parquet(ledger)

    state = f"{scratch(stream.sparkSession)}/{tag}-{hashlib.sha256(ledger.encode()).hexdigest()[:16]}-state"
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True)
