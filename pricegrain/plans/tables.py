"""Exports and streaming twins as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.plans.base import BASE, offers, stores
from pricegrain.plans.registry import query
from pricegrain.sources.export import export_rows
from pricegrain.streaming import twins


@query(BASE + """ SELECT o.product_id, o.name, o.brand, o.type, s_name AS store, o.price, CASE WHEN units > 0 AND confidence >= 0.7 THEN round(o.price / units, 6) END AS unit_price, CASE stock_status WHEN 'in_stock' THEN 'In stock' ELSE stock_status END AS stock,
  CASE WHEN o.price = b.best THEN 'yes' ELSE 'no' END AS is_best, seen_at FROM offer o JOIN supplier ON s_suppkey = store_id LEFT JOIN (SELECT product_id, min(price) AS best FROM offer WHERE available GROUP BY 1) b USING (product_id)""")
def export(spark: SparkSession, sf: str) -> DataFrame:
    return export_rows(offers(spark, sf), stores(spark, sf), {"in_stock": "In stock"}).withColumn("unit_price", F.round("unit_price", 6))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL), m AS (SELECT max(ts) AS newest FROM events)
SELECT start, event_type, n, total FROM w, m WHERE start + INTERVAL 30 MINUTE <= date_trunc('millisecond', newest) - INTERVAL 1 HOUR""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: event-time windows; those that the watermark has not passed are still open and not given."""
    return twins.finished(twins.windowed(twins.events_stream(spark, sf)), "windows").withColumn("total", F.round("total", 6))


@query("SELECT count(*) AS n_alerts, count(DISTINCT alert_id) AS n_users FROM (WITH e AS (SELECT user_id AS alert_id, event_id, ts, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_price FROM events), m AS (SELECT *, min(value) OVER (PARTITION BY alert_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE value <= target_price) SELECT * FROM m WHERE before IS NULL OR value < before)")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: R6 with a state for each key, over the events as a stream."""
    return twins.finished(twins.alerts(twins.events_stream(spark, sf)), "alerts").agg(F.count("*").alias("n_alerts"), F.count_distinct("user_id").alias("n_users"))
