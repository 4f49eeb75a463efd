"""Streams with offsets, ledgers, timers and stored tables in parts, as queries over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import parts
from pricegrain.operators.storage import scratch
from pricegrain.plans.base import table
from pricegrain.plans.registry import query
from pricegrain.sources import numbered
from pricegrain.streaming import once, terms, twins


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, value FROM events")
def numbered_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The events arrive as four numbered answers; the stream reads two, stops, and goes on from its offset."""
    numbered.register(spark)
    root, schema = _folder(spark, "answers"), "event_id long, user_id long, event_type string, value double"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    stream = spark.readStream.format("numbered_answers").schema(schema).option("path", f"{root}/in").option("ack", f"{root}/ack").load()
    for n in range(4):
        e.filter(F.pmod(F.hash("event_id"), F.lit(4)) == n).write.json(f"{root}/in/{numbered.NAME.format(n)}")
        if n % 2:
            stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL")
def published_once(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's, type's and whole value's first event is published, by two queries that share a ledger."""
    root = _folder(spark, "once")
    key = F.concat_ws("|", "user_id", "event_type", F.floor("value").cast("string"))
    e = twins.events_stream(spark, sf).select(key.alias("key"), "user_id", "event_type")
    for name in ("a", "b"):
        once.publish_once(e, "key", f"{root}/ledger", f"{root}/outbox", f"{root}/state-{name}").start().awaitTermination()
    return once.entries(spark, f"{root}/outbox", "key string, user_id long, event_type string").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH new AS (SELECT user_id, max(value) AS value, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), old AS (SELECT user_id, max(value) AS value, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(w.value, o.value) AS value, coalesce(o.n, w.n) AS n FROM old o FULL JOIN new w USING (user_id) WHERE coalesce(o.user_id, w.user_id) NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)""")
def stored_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K4, K9: users' highest values of all but clicks as a stored table; clicks are put over, the counts stay, some go."""
    path = f"{_folder(spark, 'parts')}/users"
    e = table(spark, sf, "events")
    best = lambda cond: e.filter(cond).groupBy("user_id").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    parts.create(best("event_type <> 'click'"), path, ["user_id"], 8)
    parts.upsert_parts(spark, path, best("event_type = 'click'"), keep_old=["n"])
    parts.remove_parts(spark, path, e.filter("event_type = 'error' AND value > 90").select("user_id"))
    return parts.read(spark, path)


_TERMS = """WITH RECURSIVE x AS (SELECT user_id AS m, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'signup' THEN 'joined' WHEN 'purchase' THEN 'renewed' ELSE 'left' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
s AS (
  SELECT DISTINCT user_id AS m, 0::BIGINT AS n, epoch_ms(TIMESTAMP '2024-01-01') AS t, user_id % 3 = 0 AS active, epoch_ms(TIMESTAMP '2024-01-06') AS e, NULL::VARCHAR AS action, false AS over FROM events
  UNION ALL SELECT m, x.n, x.t, CASE kind WHEN 'left' THEN false ELSE true END,
    CASE kind WHEN 'joined' THEN CASE WHEN on_ THEN s.e ELSE x.t + 5 * 86400000 END WHEN 'renewed' THEN CASE WHEN on_ THEN s.e ELSE x.t END + 3 * 86400000 ELSE s.e END,
    CASE kind WHEN 'joined' THEN CASE WHEN NOT on_ THEN 'join' END WHEN 'renewed' THEN 'renew' ELSE CASE WHEN on_ THEN 'leave' END END, s.active AND NOT on_
  FROM (SELECT s.*, x.n AS nn, s.active AND s.e > x.t AS on_ FROM s JOIN x ON x.m = s.m AND x.n = s.n + 1) s JOIN x USING (m) WHERE x.n = s.nn),
spans AS (SELECT m, t, e, active, coalesce(lead(t) OVER (PARTITION BY m ORDER BY n), (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events WHERE event_type IN ('signup', 'purchase', 'error'))) AS until FROM s)
SELECT m AS member_id, t AS at, action, NULL::INTEGER AS step FROM s WHERE action IS NOT NULL
UNION ALL SELECT m, e - k * 86400000, 'remind', k FROM spans, (VALUES (1), (2)) v(k) WHERE active AND e - k * 86400000 > t AND e - k * 86400000 <= until
UNION ALL SELECT m, e, 'expire', NULL FROM spans WHERE active AND e > t AND e <= until"""


@query(_TERMS)
def member_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Signups join for five days, purchases renew by three, errors leave; a third of the users are members at the start."""
    t = F.col("event_type")
    e = twins.events_stream(spark, sf).filter(t.isin("signup", "purchase", "error"))
    rows = e.select(F.col("user_id").alias("member_id"), "event_id", "ts", F.when(t == "signup", "joined").when(t == "purchase", "renewed").otherwise("left").alias("kind"), F.when(t == "signup", 5).otherwise(3).alias("days"))
    begun = table(spark, sf, "events").filter("user_id % 3 = 0").select(F.col("user_id").alias("member_id")).distinct().select("member_id", F.lit("2024-01-06").cast("timestamp").alias("expires_at"), F.lit("2024-01-01").cast("timestamp").alias("since"))
    return twins.finished(terms.member_terms(rows, begun, steps=(2, 1)), "terms")
