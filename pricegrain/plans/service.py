"""What the screens and messages of a price service ask for: lookups, notices, merges, front page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.functions import similarity
from pricegrain.operators import changes, market, resolve, search
from pricegrain.plans.base import BASE, bare_offers, observations, products, stores, table
from pricegrain.plans.registry import query

_TYPES = "CASE event_type WHEN 'view' THEN 'price_drop' WHEN 'click' THEN 'new_product' WHEN 'purchase' THEN 'back_in_stock' ELSE 'removed' END"
_EVENT = f"WITH e AS (SELECT event_id, user_id AS store_id, 'shop' || user_id % 5 AS store, ts AS created_at, {_TYPES} AS type, value FROM events)"


def shop_events(spark: SparkSession, sf: str) -> DataFrame:
    e, t = table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t == "view", "price_drop").when(t == "click", "new_product").when(t == "purchase", "back_in_stock").otherwise("removed")
    return e.select("event_id", F.col("user_id").alias("store_id"), F.concat(F.lit("shop"), (F.col("user_id") % 5).cast("string")).alias("store"), F.col("ts").alias("created_at"), kind.alias("type"), "value")


@query(_EVENT + """ SELECT 'on' AS mode, event_id FROM e WHERE store IN ('shop1', 'shop3') AND type IN ('price_drop', 'back_in_stock', 'new_product') UNION ALL SELECT 'over', event_id FROM e WHERE type IN ('price_drop', 'back_in_stock')
UNION ALL SELECT 'endless', event_id FROM e WHERE store = 'shop2' AND type IN ('price_drop', 'back_in_stock', 'new_product')""")
def presale_events(spark: SparkSession, sf: str) -> DataFrame:
    """a presale that lasts, one that is over, one whose last day is no date."""
    e, usual, today = shop_events(spark, sf), ["price_drop", "back_in_stock"], F.lit("2024-01-10").cast("date")
    modes = {"on": (["shop1", "shop3"], "2024-01-10"), "over": (["shop1"], "2024-01-09"), "endless": (["shop2"], "soon")}
    out = [changes.presale(e, shops, ["new_product"], usual, today, until).select(F.lit(mode).alias("mode"), "event_id") for mode, (shops, until) in modes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_EVENT + " SELECT event_id, type, created_at FROM e WHERE store_id = 7 AND type IN ('price_drop', 'back_in_stock') AND created_at >= (SELECT min(ts) FROM events) AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50)")
def unsent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Q18: events of one shop; those of a value above 50 were told of."""
    e = shop_events(spark, sf)
    first = e.agg(F.min("created_at")).first()[0]
    return changes.unsent(e, e.filter("value > 50"), 7, ["price_drop", "back_in_stock"], F.lit(first)).select("event_id", "type", "created_at")


@query("SELECT event_id AS hit_id, event_type = 'view' OR event_id IN (SELECT event_id FROM events WHERE value > 80) AS seen FROM events")
def seen_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Views were seen before; hits of a high value are marked now."""
    hits = table(spark, sf, "events").select(F.col("event_id").alias("hit_id"), "value", (F.col("event_type") == "view").alias("seen"))
    return changes.mark_seen(hits, hits.filter("value > 80")).select("hit_id", "seen")


@query("""WITH p AS (SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS game, CASE WHEN p_size % 4 <> 0 THEN p_type END AS set_code, p_size AS size FROM part)
SELECT base, candidate, candidate_name, nth FROM (SELECT b.product_id AS base, c.product_id AS candidate, c.name AS candidate_name, row_number() OVER (PARTITION BY b.product_id ORDER BY c.name, c.product_id) AS nth
  FROM p b JOIN p c ON b.product_id <> c.product_id AND (b.game IS NULL OR c.game = b.game) AND (b.set_code IS NULL OR c.set_code = b.set_code)) WHERE nth <= 12""")
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J23 for all products at once; a third of them know no game, a quarter no set."""
    p = products(spark, sf)
    p = p.select("product_id", "name", F.when(F.col("size") % 3 != 0, F.col("brand")).alias("game"), F.when(F.col("size") % 4 != 0, F.col("type")).alias("set_code"))
    return search.merge_candidates(p, p, 12, ("game", "set_code"))


@query("""WITH d AS (SELECT l_partkey AS x, l_suppkey AS y, CASE WHEN l_returnflag = 'R' THEN 'same' ELSE 'different' END AS decision FROM lineitem), k AS (SELECT 'k' || least(x, y) AS a_key, 'k' || greatest(x, y) AS b_key, decision FROM d)
SELECT a_key, b_key, decision FROM k WHERE NOT (decision = 'different' AND (CAST(a_key[2:] AS INT) % 3 = 0 AND CAST(b_key[2:] AS INT) % 5 = 0 OR CAST(a_key[2:] AS INT) % 5 = 0 AND CAST(b_key[2:] AS INT) % 3 = 0))""")
def forgotten_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A merge forgets what held the keys of its two sides apart; the sides share some keys."""
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    d = table(spark, sf, "lineitem").select(key(F.least(x, y)).alias("a_key"), key(F.greatest(x, y)).alias("b_key"), F.when(F.col("l_returnflag") == "R", "same").otherwise("different").alias("decision"))
    every = table(spark, sf, "lineitem").select(x.alias("n")).unionByName(table(spark, sf, "lineitem").select(y.alias("n"))).distinct()
    return resolve.forget_pairs(d, every.filter("n % 3 = 0").select(key(F.col("n")).alias("stable_key")), every.filter("n % 5 = 0").select(key(F.col("n")).alias("stable_key")))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"k": broken' WHEN 1 THEN NULL WHEN 2 THEN '[1, 2]' ELSE props END AS raw FROM events), j AS (SELECT event_id, try_cast(raw AS JSON) AS j FROM t), o AS (SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM j)
SELECT event_id, json_extract_string(j, '$.k') AS k, coalesce(len(json_keys(j)), 0) AS n FROM o""")
def breakdowns(spark: SparkSession, sf: str) -> DataFrame:
    """Broken, missing and other JSON reads as an empty object."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, '{"k": broken').when(k == 2, "[1, 2]").when(k != 1, F.col("props"))
    m = resolve.breakdown_of(raw)
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), F.size(m).cast("long").alias("n"))


@query("SELECT o_custkey AS member_id, max(o_orderdate) AS expires_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY expires_at, member_id")
def members_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Q15: members of a state, the next to expire first."""
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("member_id")).agg(F.max("o_orderdate").alias("expires_at")).orderBy("expires_at", "member_id")


@query("SELECT max(o_orderdate) AS finished_at FROM orders WHERE o_orderstatus = 'F'")
def last_update(spark: SparkSession, sf: str) -> DataFrame:
    """Q16: when the newest completed run ended."""
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("finished_at"))


@query("SELECT 'one' AS asked, s_suppkey AS store_id, s_name AS store FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 'code', s_suppkey, s_name FROM supplier WHERE s_name = 'Supplier#3' OR s_suppkey = try_cast('Supplier#3' AS BIGINT) UNION ALL SELECT 'enabled', s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
def store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: by number, by code, and the enabled ones (not in debt)."""
    s = stores(spark, sf).select("store_id", "store", "balance")
    named = lambda asked, df: df.select(F.lit(asked).alias("asked"), "store_id", "store")
    return named("one", search.by_id_or_code(s, "7", "store_id", "store")).unionByName(named("code", search.by_id_or_code(s, "Supplier#3", "store_id", "store"))).unionByName(named("enabled", s.filter("balance >= 0")))


@query("""WITH s AS (SELECT product_id, name, round(list_sum(list_transform(asked, lambda q: list_max(list_transform(tokens, lambda t: CASE WHEN q = t THEN 1.0 WHEN starts_with(t, q) OR starts_with(q, t) THEN 0.9 WHEN contains(t, q) THEN 0.75
  WHEN jaro_winkler_similarity(q, t) > 0.88 THEN 0.7 * jaro_winkler_similarity(q, t) ELSE 0.0 END)))) / len(asked), 9) AS score FROM (SELECT p_partkey AS product_id, p_name AS name, string_split(lower(p_name), ' ') AS tokens, ['smal', 'brass'] AS asked FROM part))
SELECT product_id, name, score FROM s WHERE score >= 0.45 ORDER BY score DESC, product_id LIMIT 8""")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Q4: names like a misspelt query."""
    p = products(spark, sf).select("product_id", "name")
    return search.suggest(p, F.round(similarity.search_score(F.array(F.lit("smal"), F.lit("brass")), F.split(F.lower("name"), " ")), 9), "smal brass")


# the last telling goes along: (signature, moment), gone where a check finds nothing
_HEALTH = """WITH RECURSIVE r AS (SELECT user_id AS store_id, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'error' THEN 'errors' WHEN 'click' THEN 'empty' ELSE '' END AS signature, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
told AS (
  SELECT store_id, n, event_id, signature, CASE WHEN signature <> '' THEN signature END AS last, CASE WHEN signature <> '' THEN us END AS told_at, signature <> '' AS tells FROM r WHERE n = 1
  UNION ALL SELECT r.store_id, r.n, r.event_id, r.signature, CASE WHEN r.signature <> '' THEN r.signature END,
    CASE WHEN r.signature = '' THEN NULL WHEN r.signature IS DISTINCT FROM t.last OR r.us - t.told_at >= 43200000000 THEN r.us ELSE t.told_at END,
    CASE WHEN r.signature = '' THEN t.last IS NOT NULL ELSE r.signature IS DISTINCT FROM t.last OR r.us - t.told_at >= 43200000000 END
  FROM told t JOIN r ON r.store_id = t.store_id AND r.n = t.n + 1)
SELECT store_id, event_id, signature FROM told WHERE tells"""


@query(_HEALTH)
def health_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the shops, whose problems are those of each event's type; recoveries are told too."""
    t = F.col("event_type")
    problems = F.filter(F.array(F.when(t == "error", "errors"), F.when(t == "click", "empty")), lambda p: p.isNotNull())
    states = table(spark, sf, "events").select(F.col("user_id").alias("store_id"), "event_id", F.col("ts").cast("timestamp").alias("checked_at"), problems.alias("problems"))
    return changes.health_notices(states, ["checked_at", "event_id"], recovered=True).select("store_id", "event_id", "signature")


@query(BASE + """, e AS (SELECT * FROM events), n AS (SELECT product_id, count(DISTINCT store_id) AS n FROM offer GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM supplier) AS stores, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS enabled_stores, (SELECT count(*) FROM offer) AS offers, (SELECT count(*) FROM offer WHERE available) AS available,
  (SELECT count(DISTINCT product_id) FROM offer WHERE available) AS products_available, (SELECT count(*) FROM n WHERE n >= 2) AS compared, (SELECT count(*) FROM offer WHERE units > 1 AND confidence < 0.7) AS pending_reviews,
  (SELECT count(DISTINCT user_id) FROM e WHERE event_type = 'purchase') AS favourites, (SELECT count(DISTINCT user_id) FROM e) AS alerts, (SELECT count(*) FROM e WHERE event_type = 'click') AS hits,
  (SELECT count(*) FROM observation) AS observations, (SELECT max(seen_at) FROM observation) AS last_seen, (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AS last_update""")
def dashboard_all(spark: SparkSession, sf: str) -> DataFrame:
    """The fourteen scalars; one pass over each table, one row each, put side by side."""
    own = bare_offers(spark, sf).select("product_id", "store_id", "available", "units", "confidence")
    per = own.groupBy("product_id").agg(
        F.count_distinct("store_id").alias("n"), F.count("*").alias("o"), F.count_if("available").alias("a"), F.count_if((F.col("units") > 1) & (F.col("confidence") < 0.7)).alias("r"),
    )
    offers_row = per.agg(F.sum("o").alias("offers"), F.sum("a").alias("available"), F.count_if(F.col("a") > 0).alias("products_available"), F.count_if(F.col("n") >= 2).alias("compared"), F.sum("r").alias("pending_reviews"))
    t = F.col("event_type")
    events_row = table(spark, sf, "events").agg(F.count_distinct(F.when(t == "purchase", F.col("user_id"))).alias("favourites"), F.count_distinct("user_id").alias("alerts"), F.count_if(t == "click").alias("hits"))
    rows = [
        products(spark, sf).agg(F.count("*").alias("products")), stores(spark, sf).agg(F.count("*").alias("stores"), F.count_if(F.col("balance") >= 0).alias("enabled_stores")), offers_row, events_row,
        observations(spark, sf).agg(F.count("*").alias("observations"), F.max("seen_at").alias("last_seen")), last_update(spark, sf).withColumnRenamed("finished_at", "last_update"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 4 AS product_key, CASE WHEN p_size % 3 = 0 THEN p_size END AS product_id FROM part),
v AS (SELECT product_key, product_id, count(*) AS n FROM p WHERE product_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY n DESC, product_id) AS nth FROM v)
SELECT (SELECT count(DISTINCT product_key) FROM p) AS groups, (SELECT count(DISTINCT product_id) FROM v) AS most, (SELECT count(*) FROM r WHERE nth = 1) AS claims""")
def kept_id_counts(spark: SparkSession, sf: str) -> DataFrame:
    """M17's input in numbers; the ids themselves are held against a plain loop in the tests."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("product_key"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("product_id"))
    voted = p.filter("product_id IS NOT NULL")
    return p.agg(F.count_distinct("product_key").alias("groups")).crossJoin(voted.agg(F.count_distinct("product_id").alias("most"), F.count_distinct("product_key").alias("claims")))


# one group after another; the products that are taken go along
_KEPT = """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 4 AS product_key, CASE WHEN p_size % 3 = 0 THEN p_size END AS product_id FROM part),
v AS (SELECT product_key, product_id, count(*) AS n FROM p WHERE product_id IS NOT NULL GROUP BY ALL), c AS (SELECT product_key, list(product_id ORDER BY n DESC, product_id) AS choices FROM v GROUP BY 1),
g AS (SELECT product_key, choices, row_number() OVER (ORDER BY product_key) AS n FROM (SELECT DISTINCT product_key FROM p) LEFT JOIN c USING (product_key)),
s AS (
  SELECT n, product_key, choices[1] AS product_id, list_filter([choices[1]], lambda x: x IS NOT NULL) AS taken FROM g WHERE n = 1
  UNION ALL SELECT n, product_key, own, CASE WHEN own IS NULL THEN taken ELSE list_append(taken, own) END FROM (
    SELECT g.n, g.product_key, s.taken, list_filter(g.choices, lambda x: NOT list_contains(s.taken, x))[1] AS own FROM s JOIN g ON g.n = s.n + 1))
SELECT product_key, product_id FROM s"""


@query(_KEPT)
def kept_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of four parts; a part's size is the old product of a third of them."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("product_key"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("product_id"))
    return resolve.keep_ids(p.select("id", "product_key"), p.select("id", "product_id"))


@query(BASE + """, named AS (SELECT o.*, CASE WHEN size <= 10 THEN 'small' WHEN size <= 30 THEN 'medium' ELSE 'large' END AS category FROM offer o), deal AS (SELECT product_id, max(price) - min(price) AS spread FROM offer WHERE available GROUP BY 1 HAVING count(*) > 1)
SELECT 'category' AS part, category AS label, CAST(NULL AS BIGINT) AS product_id, count(DISTINCT product_id) AS n FROM named GROUP BY category
UNION ALL SELECT 'viewed', NULL, user_id, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8)
UNION ALL SELECT 'deal', NULL, product_id, NULL FROM (SELECT product_id FROM deal ORDER BY round(spread, 6) DESC, product_id LIMIT 8)
UNION ALL SELECT 'newest', NULL, product_id, NULL FROM (SELECT product_id, max(seen_at) AS t FROM offer GROUP BY 1 ORDER BY t DESC, product_id DESC LIMIT 8)""")
def home(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: the front page as one result: categories, most viewed, deals, newest."""
    own = bare_offers(spark, sf).select("product_id", "price", "available", "seen_at")
    per = own.groupBy("product_id").agg(F.max("seen_at").alias("t"), F.count_if("available").alias("n"), F.round(F.max(F.when(F.col("available"), F.col("price"))) - F.min(F.when(F.col("available"), F.col("price"))), 6).alias("spread"))
    sized = per.join(products(spark, sf).select("product_id", "size"), "product_id")
    shape = lambda df, part, label=None, n=None: df.select(F.lit(part).alias("part"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), (F.lit(None).cast("long") if label else F.col("product_id")).alias("product_id"), (F.col(n) if n else F.lit(None).cast("long")).alias("n"))
    category = F.when(F.col("size") <= 10, "small").when(F.col("size") <= 30, "medium").otherwise("large")
    views = table(spark, sf, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("product_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_id").limit(8)
    return (
        shape(sized.groupBy(category.alias("category")).agg(F.count("*").alias("n")), "category", "category", "n").unionByName(shape(views, "viewed", n="n"))
        .unionByName(shape(per.filter("n > 1").orderBy(F.desc("spread"), "product_id").limit(8), "deal")).unionByName(shape(per.orderBy(F.desc("t"), F.desc("product_id")).limit(8), "newest"))
    )


@query(BASE + """, e AS (SELECT DISTINCT ON (product_id) product_id, store_id, price, available FROM offer ORDER BY product_id, NOT available, price, offer_id)
SELECT product_id, price FROM e WHERE available AND price <= 20000""")
def open_alert_prices(spark: SparkSession, sf: str) -> DataFrame:
    """R6 for alerts that look at available offers only: the price is that of the cheapest open one."""
    best = market.offer_summary(bare_offers(spark, sf)).select("product_id", F.col("best_available").alias("price"))
    return best.filter("price <= 20000")


@query(_EVENT + """, q AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at, event_id) AS page FROM e), stop AS (SELECT store_id, min(page) AS page FROM q WHERE type = 'removed' GROUP BY 1)
SELECT event_id, store_id, page FROM q LEFT JOIN stop s USING (store_id, page) ANTI JOIN (SELECT q.event_id FROM q JOIN stop s ON s.store_id = q.store_id AND q.page >= s.page) x USING (event_id)""".replace("LEFT JOIN stop s USING (store_id, page) ", ""))
def pages_until_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A shop's pages in order up to the first empty one (events of the type removed stand for those)."""
    w = W.partitionBy("store_id").orderBy("created_at", "event_id")
    rows = shop_events(spark, sf).withColumn("page", F.row_number().over(w)).withColumn("_stop", F.max((F.col("type") == "removed").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter("_stop = 0").select("event_id", "store_id", "page")
