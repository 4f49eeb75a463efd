"""Change feed, alerts, watch list, ledgers and the other consumers of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import money
from pricegrain.operators import changes, history, market, storage
from pricegrain.plans.base import BASE, NEWEST, bare_offers, observations, stores, table
from pricegrain.plans.registry import query

_ASC = ", ".join(NEWEST[1:])
ORDER = ["seen_at", *NEWEST[1:]]

_EVENTS = BASE + f""", moved AS (SELECT product_id, store_id, offer_id, seen_at AS created_at, price, stock_status, lag(price) OVER w AS op, lag(stock_status) OVER w AS os, row_number() OVER w AS nth FROM observation WINDOW w AS (PARTITION BY product_id, store_id ORDER BY seen_at, {_ASC})),
feed AS (
  SELECT product_id, store_id, offer_id, created_at, nth, CASE WHEN price < op THEN 'price_drop' ELSE 'price_rise' END AS type, op AS old_price, price AS new_price, NULL AS old_status, NULL AS new_status FROM moved WHERE nth > 1 AND abs(price - op) > 0.001
  UNION ALL SELECT product_id, store_id, offer_id, created_at, nth, CASE WHEN stock_status = 'in_stock' AND os IN ('out_of_stock', 'coming_soon') THEN 'back_in_stock' WHEN stock_status = 'out_of_stock' THEN 'out_of_stock' ELSE 'stock_change' END, NULL, NULL, os, stock_status FROM moved WHERE nth > 1 AND stock_status <> os)"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return history.price_changes(observations(spark, sf, *NEWEST[1:]), ["product_id", "store_id", "offer_id"], ORDER)


@query(_EVENTS + " SELECT product_id, store_id, created_at, nth, type, old_price, new_price, old_status, new_status FROM feed")
def change_events(spark: SparkSession, sf: str) -> DataFrame:
    e = feed(spark, sf)
    by_price = F.col("type").startswith("price")
    num = lambda c: F.when(by_price, F.col(c).try_cast("double"))
    txt = lambda c: F.when(~by_price, F.col(c))
    return e.select("product_id", "store_id", "created_at", "nth", "type", num("old_value").alias("old_price"), num("new_value").alias("new_price"), txt("old_value").alias("old_status"), txt("new_value").alias("new_status"))


@query(_EVENTS + " SELECT product_id, round(max(old_price - new_price), 6) AS amount FROM feed WHERE type = 'price_drop' AND created_at >= TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY amount DESC, product_id LIMIT 30")
def price_drops(spark: SparkSession, sf: str) -> DataFrame:
    return history.daily_deals(feed(spark, sf), F.lit("1997-01-01").cast("timestamp"), 30).withColumn("amount", F.round("amount", 6))


# the moment of the last record goes along
_RECORDED = """r AS (
  SELECT k, n, t, price, t AS last, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.n, o.t, o.price, CASE WHEN abs(o.price - o.p) > 0.001 OR epoch_us(o.t) - epoch_us(r.last) >= 86400000000 THEN o.t ELSE r.last END,
    abs(o.price - o.p) > 0.001 OR epoch_us(o.t) - epoch_us(r.last) >= 86400000000 FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)"""


@query(BASE.replace("WITH", "WITH RECURSIVE", 1) + f""", o AS (SELECT product_id * 1000000 + store_id AS k, seen_at AS t, price, lag(price) OVER v AS p, row_number() OVER v AS n FROM observation WINDOW v AS (PARTITION BY product_id, store_id ORDER BY seen_at, {_ASC})), {_RECORDED}
SELECT k // 1000000 AS product_id, k % 1000000 AS store_id, t AS seen_at, price FROM r WHERE kept""")
def price_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return history.snapshots(observations(spark, sf, *NEWEST[1:]), ["product_id", "store_id"], ORDER).select("product_id", "store_id", "seen_at", "price")


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS k, event_id, ts AS t, floor(value / 60) AS price, lag(floor(value / 60)) OVER v AS p, row_number() OVER v AS n FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id)), {_RECORDED}
SELECT r.k AS user_id, event_id, r.price FROM r JOIN o ON o.k = r.k AND o.n = r.n WHERE kept""")
def event_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """R3 over long series of prices that seldom move: what is recorded hangs on the last record."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("seen_at"), F.floor(F.col("value") / 60).cast("double").alias("price"))
    return history.snapshots(e, ["user_id"], ["seen_at", "event_id"]).select("user_id", "event_id", "price")


@query("""WITH o AS (SELECT user_id, event_id, floor(value / 10) AS price, CASE event_type WHEN 'click' THEN 'in_stock' WHEN 'view' THEN 'coming_soon' ELSE 'out_of_stock' END AS stock, 'n' || CAST(floor(value / 40) AS INT) AS name, row_number() OVER w AS nth,
  lag(floor(value / 10)) OVER w AS p0, lag(CASE event_type WHEN 'click' THEN 'in_stock' WHEN 'view' THEN 'coming_soon' ELSE 'out_of_stock' END) OVER w AS s0, lag('n' || CAST(floor(value / 40) AS INT)) OVER w AS n0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM o WHERE nth > 1 AND (price <> p0 OR name <> n0))
SELECT user_id, nth, CASE WHEN price < p0 THEN 'price_drop' ELSE 'price_rise' END AS type FROM c WHERE price <> p0
UNION ALL SELECT user_id, nth, CASE WHEN stock = 'in_stock' THEN 'back_in_stock' WHEN stock = 'out_of_stock' THEN 'out_of_stock' ELSE 'stock_change' END FROM c WHERE stock <> s0 UNION ALL SELECT user_id, nth, 'name_change' FROM c WHERE name <> n0""")
def digest_events(spark: SparkSession, sf: str) -> DataFrame:
    """R2, W11 with names: only where the digest, here of price and name, is another than before."""
    t = F.col("event_type")
    e = table(spark, sf, "events").select(
        "user_id", "event_id", F.col("ts").alias("seen_at"), F.floor(F.col("value") / 10).cast("double").alias("price"), F.when(t == "click", "in_stock").when(t == "view", "coming_soon").otherwise("out_of_stock").alias("stock_status"),
        F.concat(F.lit("n"), F.floor(F.col("value") / 40).cast("string")).alias("name"),
    ).withColumn("digest", F.md5(F.concat_ws("|", "price", "name")))
    return history.price_changes(e, ["user_id"], ["seen_at", "event_id"], name="name", digest="digest").select("user_id", "nth", "type")


@query(BASE + """, a AS (SELECT product_id, store_id, max(CASE WHEN seen_at < TIMESTAMP '1996-01-01' THEN price END) AS old, max(CASE WHEN seen_at >= TIMESTAMP '1995-01-01' THEN price END) AS now FROM observation GROUP BY ALL)
SELECT store_id, product_id AS offer_key, CASE WHEN old IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN old = now THEN 'unchanged' ELSE 'changed' END AS change FROM a WHERE old IS NOT NULL OR now IS NOT NULL""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping periods as two snapshots; every shop is seen in the second one."""
    o = observations(spark, sf)
    snap = lambda cond: o.filter(cond).groupBy("store_id", F.col("product_id").alias("offer_key")).agg(F.max("price").alias("content_hash"))
    return changes.snapshot_diff(snap("seen_at < TIMESTAMP '1996-01-01'"), snap("seen_at >= TIMESTAMP '1995-01-01'"))


@query(BASE + """ SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'removed' WHEN a.p = b.p THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT store_id, product_id, max(price) AS p FROM observation WHERE seen_at < TIMESTAMP '1996-01-01' GROUP BY ALL) a FULL JOIN (SELECT store_id, product_id, max(price) AS p FROM observation WHERE seen_at >= TIMESTAMP '1995-01-01' GROUP BY ALL) b USING (store_id, product_id)) GROUP BY 1""")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_diff(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


_ALERT = """WITH e AS (SELECT user_id AS alert_id, event_id, ts, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_price FROM events), m AS (SELECT *, min(value) OVER (PARTITION BY alert_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE value <= target_price)
SELECT alert_id, event_id, value AS price, target_price FROM m WHERE before IS NULL OR value < before"""


@query(_ALERT)
def alert_ratchet(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first value is the target of an alert."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("price"))
    alerts = e.groupBy("user_id").agg(F.min_by("price", F.struct("ts", "event_id")).alias("target_price")).select("user_id", F.col("user_id").alias("alert_id"), "target_price", F.lit(None).cast("double").alias("last_triggered_price"))
    return changes.alert_hits(e, alerts, "user_id", ["ts", "event_id"]).select("alert_id", "event_id", "price", "target_price")


_WATCH = """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS http, CASE event_type WHEN 'click' THEN 'in_stock' WHEN 'view' THEN 'preorder' WHEN 'purchase' THEN 'out_of_stock' ELSE 'unknown' END AS stock, value AS price FROM events),
w AS (SELECT *, lag(http) OVER v AS h0, lag(stock) OVER v AS s0, lag(price) OVER v AS p0, row_number() OVER v AS nth FROM s WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN h0 >= 400 THEN 'published' WHEN stock IN ('in_stock', 'preorder') AND s0 NOT IN ('in_stock', 'preorder') THEN 'purchasable' WHEN stock NOT IN ('in_stock', 'preorder') AND s0 IN ('in_stock', 'preorder') THEN 'sold_out'
  WHEN abs(price - p0) > 1 THEN CASE WHEN price > p0 THEN 'price_up' ELSE 'price_down' END END AS event FROM w WHERE nth > 1 AND http < 400)
SELECT user_id, event_id, event, CASE WHEN event LIKE 'price%' THEN p0 END AS price_before FROM k WHERE event IS NOT NULL"""


@query(_WATCH)
def watch_fsm(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.col("event_type")
    states = e.select("user_id", "event_id", "ts", F.when(t == "error", 404).otherwise(200).alias("http_status"), F.when(t == "click", "in_stock").when(t == "view", "preorder").when(t == "purchase", "out_of_stock").otherwise("unknown").alias("stock_status"), F.col("value").alias("price"))
    return changes.watch_events(states, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event", "price_before")


@query("""SELECT event_id, ts AS created_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ORDER BY ts, event_id LIMIT 100""")
def publish_queue(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), "event_type")
    newest = e.agg(F.max("created_at")).first()[0]
    return changes.to_publish(e, e.filter("event_type = 'view'"), F.lit(newest) - F.expr("INTERVAL '48' HOUR"), 100).select("event_id", "created_at")


@query(_EVENTS + """, p AS (SELECT offer_id, price <= min(price) OVER (PARTITION BY product_id) + 1 AND count(*) OVER (PARTITION BY product_id) >= 2 AS cheapest FROM offer WHERE available)
SELECT offer_id, nth, type FROM feed LEFT JOIN p USING (offer_id) WHERE type = 'price_drop' AND old_price - new_price >= 500 AND abs(round((new_price - old_price) / old_price * 100, 4)) BETWEEN 5 AND 60 OR type = 'back_in_stock' AND cheapest""")
def worth_telling(spark: SparkSession, sf: str) -> DataFrame:
    position = market.market_position(bare_offers(spark, sf))
    return changes.worth_telling(feed(spark, sf), position, 500, 5, 60).select("offer_id", "nth", "type")


@query("""WITH r AS (SELECT l_suppkey AS store_id, year(l_shipdate) AS run_id, count(*) AS found, count(*) FILTER (l_quantity = 1) AS errors FROM lineitem GROUP BY ALL), w AS (SELECT *, lag(found) OVER (PARTITION BY store_id ORDER BY run_id) AS b, row_number() OVER (PARTITION BY store_id ORDER BY run_id DESC) AS nth FROM r)
SELECT store_id, run_id, found, errors, list_filter([CASE WHEN found = 0 THEN 'empty' END, CASE WHEN errors >= 2 THEN 'errors' END, CASE WHEN (b - found) / b >= 0.25 THEN 'shrunk' END], lambda x: x IS NOT NULL) AS problems FROM w WHERE nth = 1""")
def store_health(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("store_id"), F.year("l_shipdate").alias("run_id")).agg(F.count("*").alias("found"), F.count_if(F.col("l_quantity") == 1).alias("errors"))
    return changes.store_health(runs, min_errors=2)


@query("""WITH m AS (SELECT o_custkey AS member_id, max(o_orderdate) AS t FROM orders GROUP BY 1), d AS (SELECT member_id, t, greatest(CAST(ceil((epoch(t) - epoch(TIMESTAMP '1998-06-01')) / 86400) AS INT), 0) AS days_left FROM m)
SELECT member_id, days_left, CASE WHEN days_left <= 1 THEN 1 WHEN days_left <= 3 THEN 3 WHEN days_left <= 7 THEN 7 END AS step, CASE WHEN t <= TIMESTAMP '1998-06-01' THEN 'expire' ELSE 'remind' END AS action FROM d
WHERE t <= TIMESTAMP '1998-06-01' OR days_left <= 7 AND NOT (CASE WHEN days_left <= 1 THEN 1 WHEN days_left <= 3 THEN 3 ELSE 7 END = 3)""")
def expiry_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A member's newest order is the end of the term; step 3 was reminded of already."""
    members = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member_id")).agg(F.max("o_orderdate").cast("timestamp").alias("expires_at")).withColumns({"state": F.lit("active"), "reminded": F.lit(3)})
    return changes.reminders(members, F.lit("1998-06-01").cast("timestamp"), [1, 3, 7]).select("member_id", "days_left", "step", "action")


@query("""WITH old AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance, 'old' AS note FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS k, upper(s_name) AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal + 1 END AS balance, 'new' AS note FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL OR o.k IS NOT NULL AND o.balance < 0 THEN o.name ELSE n.name END AS name, CASE WHEN n.k IS NULL OR o.k IS NOT NULL AND o.balance < 0 THEN o.balance ELSE coalesce(n.balance, o.balance) END AS balance, coalesce(o.note, n.note) AS note FROM old o FULL JOIN new n ON o.k = n.k""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Insert or update; a note stays as it was, a null keeps the old balance, rows in debt are not updated."""
    s = stores(spark, sf).select(F.col("store_id").alias("k"), F.col("store").alias("name"), "balance")
    old = s.filter("k % 3 <> 0").withColumn("note", F.lit("old"))
    new = s.filter("k % 2 = 0").select("k", F.upper("name").alias("name"), F.when(F.col("k") % 4 != 0, F.col("balance") + 1).alias("balance"), F.lit("new").alias("note"))
    return storage.upsert(old, new, ["k"], keep_old=["note"], keep_null=["balance"], guard=F.col("o.balance") >= 0)


@query("""SELECT user_id AS k FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) UNION SELECT user_id FROM events WHERE event_type = 'view' AND value > 99""")
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Remove tombstones, then insert what is not there."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "k")
    kept = storage.remove(e.filter("event_type = 'click'").select("k").distinct(), e.filter("event_type = 'error' AND value > 90"), ["k"])
    return storage.insert_new(kept, e.filter("event_type = 'view' AND value > 99").select("k"), ["k"])


@query("""SELECT entity_key, map_from_entries(list((attribute, value) ORDER BY attribute)) AS attributes FROM (SELECT user_id AS entity_key, event_type AS attribute, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY ALL) GROUP BY 1""".replace("map_from_entries(list((attribute, value) ORDER BY attribute))", "string_agg(attribute || '=' || value, ';' ORDER BY attribute)"))
def attribute_map(spark: SparkSession, sf: str) -> DataFrame:
    """K6, Q13: rows of attributes to one map a key, shown as text."""
    eav = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_key"), F.col("event_type").alias("attribute")).agg(F.count("*").cast("string").alias("value"))
    m = eav.groupBy("entity_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("m"))
    return m.select("entity_key", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("attributes"))


@query("SELECT p_partkey AS k, attribute, value FROM (UNPIVOT (SELECT p_partkey, p_brand AS brand, nullif(p_type, 'ECONOMY') AS type, CAST(nullif(p_size, 7) AS VARCHAR) AS size FROM part) ON brand, type, size INTO NAME attribute VALUE value)")
def unpivoted(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.nullif("p_type", F.lit("ECONOMY")).alias("type"), F.nullif("p_size", F.lit(7)).cast("string").alias("size"))
    return p.unpivot(["k"], ["brand", "type", "size"], "attribute", "value").filter("value IS NOT NULL")


@query(_EVENTS + """ SELECT product_id, nth, '↓ ' || p_name || ': $' || translate(format('{:,}', CAST(round(CAST(old_price AS DECIMAL(18, 2)), 0) AS BIGINT)), ',.', '.,') || ' → $' || translate(format('{:,}', CAST(round(CAST(new_price AS DECIMAL(18, 2)), 0) AS BIGINT)), ',.', '.,') AS line FROM feed JOIN part ON p_partkey = product_id WHERE type = 'price_drop'""")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every drop; halves are rounded away from zero."""
    from pricegrain.plans.base import products

    e = feed(spark, sf).filter("type = 'price_drop'").withColumns({"o": F.col("old_value").try_cast("double"), "n": F.col("new_value").try_cast("double")})
    named = e.join(products(spark, sf).select("product_id", "name"), "product_id")
    return named.select("product_id", "nth", money.event_line("type", "name", "o", "n").alias("line"))
