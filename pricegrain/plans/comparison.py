"""Product comparison, price history and market reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.operators import history, market, search
from pricegrain.plans.base import BASE, NEWEST, available, bare_offers, observations, offers, products, stores, table
from pricegrain.plans.registry import query


@query(BASE + " SELECT offer_id, product_id, store_id, price, stock_status, available, units, confidence, seen_at FROM offer")
def latest_offer(spark: SparkSession, sf: str) -> DataFrame:
    return bare_offers(spark, sf)


_SUMMARY = """summary AS (
  SELECT product_id, count(*) AS n_offers, count(DISTINCT store_id) AS n_stores, count(*) FILTER (available) AS n_available, min(price) AS best_price,
    arg_min(store_id, (price, offer_id)) AS best_store, min(price) FILTER (available) AS best_available, arg_min(store_id, (price, offer_id)) FILTER (available) AS best_available_store,
    max(price) AS highest, avg(price) AS mean, max(seen_at) AS last_seen FROM offer GROUP BY product_id
)"""


@query(BASE + f", {_SUMMARY} SELECT * REPLACE (round(mean, 6) AS mean) FROM summary")
def offer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return market.offer_summary(bare_offers(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(BASE + """, priced AS (SELECT *, nullif(price, round(price)) AS p FROM offer), w AS (
  SELECT product_id, store_id, p, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY product_id ORDER BY p IS NULL, available DESC, p, offer_id) END AS rank,
    coalesce(min(CASE WHEN available THEN p END) OVER (PARTITION BY product_id), min(p) OVER (PARTITION BY product_id)) AS reference FROM priced)
SELECT product_id, store_id, p AS price, rank, reference, coalesce(p = reference, false) AS is_best,
  round(CASE WHEN p > 0 THEN p - reference END, 6) AS over_amount, round(CASE WHEN p > 0 THEN (p - reference) / p * 100 END, 6) AS over_percent FROM w""")
def offer_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Whole prices are taken for missing, to have some."""
    own = bare_offers(spark, sf).withColumn("price", F.nullif("price", F.round("price")))
    return market.offer_ranks(own).select("product_id", "store_id", "price", "rank", "reference", "is_best", F.round("over_amount", 6).alias("over_amount"), F.round("over_percent", 6).alias("over_percent"))


_OPPORTUNITIES = BASE + """ SELECT product_id, count(DISTINCT store_id) AS n_stores, median(price) AS median_price, min(price) AS best_price, arg_min(store_id, (price, offer_id)) AS best_store,
  round(median(price) - min(price), 6) AS saving, round((median(price) - min(price)) / median(price) * 100, 6) AS saving_percent, list(price ORDER BY price)[1:6] AS lowest_prices
FROM offer WHERE available GROUP BY product_id HAVING count(DISTINCT store_id) >= 2 AND median(price) > min(price)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"saving": F.round("saving", 6), "saving_percent": F.round("saving_percent", 6)})


@query(_OPPORTUNITIES)
def opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(market.opportunities(bare_offers(spark, sf), top=None))


@query(_OPPORTUNITIES + " ORDER BY round(saving, 6) DESC, product_id LIMIT 24")
def opportunities_top(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(market.opportunities(bare_offers(spark, sf), top=None)).orderBy(F.desc("saving"), "product_id").limit(24)


@query(BASE + """ SELECT product_id, min(price / units) AS unit_price, arg_min(store_id, (price / units, offer_id)) AS store_id, arg_min(price, (price / units, offer_id)) AS price, arg_min(units, (price / units, offer_id)) AS units
FROM offer WHERE available AND units > 1 AND confidence >= 0.7 GROUP BY product_id ORDER BY unit_price, product_id LIMIT 50""")
def unit_price_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return market.unit_price_ranking(bare_offers(spark, sf), 50)


@query(BASE + """ SELECT product_id, lowest, highest, n_prices, current, round((highest - current) / highest * 100, 6) AS drop_pct
FROM (SELECT product_id, min(price) AS lowest, max(price) AS highest, count(DISTINCT price) AS n_prices FROM observation GROUP BY product_id) JOIN (SELECT product_id, min(price) AS current FROM offer WHERE available GROUP BY product_id) USING (product_id)
WHERE n_prices >= 2 AND current <= lowest * 1.02""")
def historic_lows(spark: SparkSession, sf: str) -> DataFrame:
    current = bare_offers(spark, sf).filter("available").groupBy("product_id").agg(F.min("price").alias("current"))
    return history.price_lows(observations(spark, sf), current).withColumn("drop_pct", F.round("drop_pct", 6))


@query(BASE + """, moment AS (SELECT DISTINCT product_id, seen_at FROM observation), point AS (SELECT product_id, store_id, seen_at, min(price) AS price FROM observation GROUP BY ALL),
span AS (SELECT *, lead(seen_at) OVER (PARTITION BY product_id, store_id ORDER BY seen_at) AS until FROM point)
SELECT m.product_id, m.seen_at, min(s.price) AS best_price FROM moment m JOIN span s ON s.product_id = m.product_id AND s.seen_at <= m.seen_at AND (s.until IS NULL OR s.until > m.seen_at) GROUP BY ALL""")
def running_best_price(spark: SparkSession, sf: str) -> DataFrame:
    return history.running_best(observations(spark, sf))


@query(BASE + " SELECT product_id, store_id, list(epoch_us(seen_at) // 1000000 || ' ' || CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR) ORDER BY seen_at, price) AS series FROM observation GROUP BY product_id, store_id")
def store_series(spark: SparkSession, sf: str) -> DataFrame:
    """The points of each offer, as 'second price', in time's order."""
    point = F.concat_ws(" ", F.unix_timestamp("seen_at").cast("string"), F.col("price").cast("decimal(18,2)").cast("string"))
    listed = observations(spark, sf).withColumn("point", point).groupBy("product_id", "store_id").agg(F.sort_array(F.collect_list(F.struct("seen_at", "price", "point"))).alias("s"))
    return listed.select("product_id", "store_id", F.transform("s", lambda x: x["point"]).alias("series"))


@query(BASE + """, t AS (SELECT product_id, store_id, seen_at, min(price) AS price FROM observation GROUP BY ALL)
SELECT product_id, store_id, seen_at, price, lead(seen_at) OVER (PARTITION BY product_id, store_id ORDER BY seen_at) AS until FROM t""")
def price_steps(spark: SparkSession, sf: str) -> DataFrame:
    points = observations(spark, sf).groupBy("product_id", "store_id", "seen_at").agg(F.min("price").alias("price"))
    return history.held_until(points, ["product_id", "store_id"]).select("product_id", "store_id", "seen_at", "price", "until")


@query(BASE + " SELECT product_id, count(*) AS n, min(price) AS lowest, max(price) AS highest, round(avg(price), 6) AS mean FROM observation GROUP BY product_id")
def history_stats(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.round(F.avg("price"), 6).alias("mean"))


@query("""SELECT facet, value, count(*) AS n FROM (UNPIVOT (SELECT CAST(p_brand AS VARCHAR) AS brand, CAST(p_type AS VARCHAR) AS type, coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'unknown') AS size FROM part) ON brand, type, size INTO NAME facet VALUE value) GROUP BY ALL""")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    """Size 7 is taken for unknown, to have a null."""
    return market.facets(products(spark, sf).withColumn("size", F.nullif("size", F.lit(7))), ["brand", "type", "size"])


@query(BASE + " SELECT min(price) AS lowest, max(price) AS highest, count(DISTINCT store_id) AS n_stores FROM offer WHERE available")
def facet_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return bare_offers(spark, sf).filter("available").agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.count_distinct("store_id").alias("n_stores"))


_FAMILIES = [("small", 1, 1, 10), ("medium", 2, 11, 30), ("large", 3, 31, 50), ("giant", 4, 51, 99)]


@query("""SELECT category, position, count(*) AS n FROM part JOIN (VALUES ('small', 1, 1, 10), ('medium', 2, 11, 30), ('large', 3, 31, 50), ('giant', 4, 51, 99)) AS f(category, position, low, high) ON p_size BETWEEN low AND high GROUP BY ALL""")
def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([(c, i, s) for c, i, a, b in _FAMILIES for s in range(a, b + 1)], "category string, position int, type int")
    return market.category_rollup(products(spark, sf).groupBy(F.col("size").alias("type")).agg(F.count("*").alias("n")), members)


@query(BASE + """ SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM supplier) AS stores, (SELECT count(*) FROM offer) AS offers, (SELECT count(*) FROM offer WHERE available) AS available,
  (SELECT count(DISTINCT product_id) FROM offer WHERE available) AS products_available, (SELECT count(*) FROM observation) AS observations, (SELECT max(seen_at) FROM observation) AS last_seen""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    own = bare_offers(spark, sf).agg(F.count("*").alias("offers"), F.count_if("available").alias("available"), F.count_distinct(F.when(F.col("available"), F.col("product_id"))).alias("products_available"))
    seen = observations(spark, sf).agg(F.count("*").alias("observations"), F.max("seen_at").alias("last_seen"))
    return products(spark, sf).agg(F.count("*").alias("products")).crossJoin(stores(spark, sf).agg(F.count("*").alias("stores"))).crossJoin(own).crossJoin(seen)


@query(BASE + """ SELECT s_suppkey AS store_id, s_name AS store, (SELECT count(*) FROM offer WHERE store_id = s_suppkey) AS n_offers, (SELECT count(*) FROM offer WHERE store_id = s_suppkey AND available) AS n_available,
  (SELECT max(seen_at) FROM offer WHERE store_id = s_suppkey) AS last_seen, (SELECT round(avg(price), 6) FROM offer WHERE store_id = s_suppkey) AS mean_price,
  (SELECT arg_max(stock_status, (seen_at, offer_id)) FROM offer WHERE store_id = s_suppkey) AS newest_status FROM supplier""")
def store_overview(spark: SparkSession, sf: str) -> DataFrame:
    per = bare_offers(spark, sf).groupBy("store_id").agg(
        F.count("*").alias("n_offers"), F.count_if("available").alias("n_available"), F.max("seen_at").alias("last_seen"), F.round(F.avg("price"), 6).alias("mean_price"),
        F.max_by("stock_status", F.struct("seen_at", "offer_id")).alias("newest_status"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stores(spark, sf).join(per, "store_id", "left").select("store_id", "store", zero("n_offers"), zero("n_available"), "last_seen", "mean_price", "newest_status")


@query(BASE + """, n AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM offer), m AS (SELECT a.product_id, a.offer_id, a.price, median(b.price) AS m FROM n a JOIN n b ON a.product_id = b.product_id AND a.offer_id <> b.offer_id WHERE a.n >= 3 GROUP BY ALL)
SELECT product_id, offer_id, price, round(m, 6) AS others_median, price / m < 0.45 OR price / m > 2.5 AS outlier FROM m""")
def median_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return market.leave_one_out(bare_offers(spark, sf)).select("product_id", "offer_id", "price", F.round("others_median", 6).alias("others_median"), "outlier")


@query(BASE + """, w AS (SELECT *, min(price) OVER (PARTITION BY product_id) AS lowest, count(*) OVER (PARTITION BY product_id) AS n_open FROM offer WHERE available)
SELECT product_id, store_id, price, lowest, n_open, price <= lowest + 1 AS cheapest FROM w WHERE n_open >= 2""")
def market_position(spark: SparkSession, sf: str) -> DataFrame:
    return market.market_position(bare_offers(spark, sf)).select("product_id", "store_id", "price", "lowest", "n_open", "cheapest")


@query(BASE + """, c AS (SELECT store_id, stock_status, count(*) AS n, min(offer_id) AS first FROM offer GROUP BY ALL)
SELECT store_id, arg_max(stock_status, (n, -first)) AS stock_status FROM c GROUP BY store_id""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return market.majority(bare_offers(spark, sf), "store_id", "stock_status", "offer_id")


@query(BASE + """, c1 AS (SELECT brand, type AS v, count(*) AS n, min(offer_id) AS f FROM offer GROUP BY ALL), c2 AS (SELECT brand, name AS v, count(*) AS n, min(offer_id) AS f FROM offer GROUP BY ALL),
c3 AS (SELECT brand, CAST(units AS VARCHAR) AS v, count(*) AS n, min(offer_id) AS f FROM offer WHERE confidence >= 0.7 GROUP BY ALL)
SELECT a.brand, a.type, b.name, c.units FROM (SELECT brand, arg_max(v, (n, -f)) AS type FROM c1 GROUP BY 1) a JOIN (SELECT brand, arg_max(v, (n, -f)) AS name FROM c2 GROUP BY 1) b USING (brand) JOIN (SELECT brand, CAST(arg_max(v, (n, -f)) AS INT) AS units FROM c3 GROUP BY 1) c USING (brand)""")
def master_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return market.master_attributes(offers(spark, sf), "brand", ["type", "name"], "offer_id")


@query("SELECT p_brand AS brand, arg_min(p_name, (length(p_name), p_partkey)) AS name FROM part GROUP BY 1")
def shortest_name(spark: SparkSession, sf: str) -> DataFrame:
    return market.shortest_name(products(spark, sf), "brand", "name", "product_id")


_STATES = ["in_stock", "preorder", "out_of_stock", "coming_soon", "unknown"]


@query(BASE + f" SELECT store_id, {', '.join(f'count(*) FILTER (stock_status = {s!r}) AS {s}' for s in _STATES)} FROM offer GROUP BY store_id")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return market.status_pivot(bare_offers(spark, sf), "store_id", "stock_status", _STATES)


@query(BASE + " SELECT count(*) FILTER (available) AS open, count(*) FILTER (stock_status = 'out_of_stock') AS sold_out, count(*) FILTER (stock_status = 'coming_soon') AS soon, count(*) FILTER (stock_status = 'unknown') AS unreadable FROM offer")
def watch_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("stock_status")
    return bare_offers(spark, sf).agg(F.count_if("available").alias("open"), F.count_if(s == "out_of_stock").alias("sold_out"), F.count_if(s == "coming_soon").alias("soon"), F.count_if(s == "unknown").alias("unreadable"))


@query(BASE + " SELECT offer_id, sha256(concat_ws('|', CAST(product_id AS VARCHAR), CAST(store_id AS VARCHAR), stock_status, coalesce(CAST(nullif(units, 7) AS VARCHAR), 'None'))) AS content_hash FROM offer")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return bare_offers(spark, sf).withColumn("units", F.nullif("units", F.lit(7))).select("offer_id", market.content_hash("product_id", "store_id", "stock_status", "units").alias("content_hash"))


@query("""SELECT greatest(max(o), max(l)) AS newest FROM (SELECT (SELECT max(o_orderdate) FROM orders) AS o, (SELECT max(l_shipdate) FROM lineitem) AS l)""")
def union_last(spark: SparkSession, sf: str) -> DataFrame:
    """Newest entry of two ledgers."""
    a = table(spark, sf, "orders").select(F.col("o_orderdate").alias("t"))
    return a.unionByName(table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("t"))).agg(F.max("t").alias("newest"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS total FROM orders GROUP BY 1), w AS (SELECT month, total, lag(total) OVER (ORDER BY month) AS before FROM m)
SELECT strftime(month, '%Y-%m') AS month, total, before, round((before - total) / before, 9) AS drop_share, coalesce((before - total) / before >= 0.25, false) AS alarm FROM w""")
def catalogue_drop(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger is one row a month, so its window without a partition stays small."""
    runs = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"))
    return market.total_drop(runs, "month", "total").withColumn("drop_share", F.round("drop_share", 9))


@query(BASE + """ SELECT product_id, store_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price DESC, offer_id) AS rn FROM offer) WHERE rn <= 3""")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("product_id").orderBy(F.desc("price"), "offer_id")
    return bare_offers(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("product_id", "store_id", "rn")


@query(BASE + """, s AS (SELECT a.product_id, b.product_id AS other, b.brand AS edition, round(greatest(0, 1 - abs(a.size - b.size) / 50.0), 6) AS likeness FROM (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part) a
  JOIN (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part) b ON a.name = b.name AND a.type = b.type AND a.brand <> b.brand)
SELECT product_id, edition, other, likeness FROM (SELECT *, row_number() OVER (PARTITION BY product_id, edition ORDER BY likeness DESC, other) AS rn FROM s WHERE likeness >= 0.55) WHERE rn = 1""")
def similar_editions(spark: SparkSession, sf: str) -> DataFrame:
    """For each product the most alike of each other edition (brand), of the same name and type."""
    p = products(spark, sf)
    return search.nearest_editions(p, ["name", "type"], "brand", "size", 50, 0.55).withColumn("likeness", F.round("likeness", 6))


@query(BASE + f""", {_SUMMARY}, r AS (SELECT offer_id, product_id, store_id, price, row_number() OVER (PARTITION BY product_id ORDER BY available DESC, price, offer_id) AS rank FROM offer), h AS (SELECT product_id, count(*) AS n_seen, min(price) AS lowest_ever FROM observation GROUP BY 1)
SELECT r.product_id, p_name AS name, s_name AS store, price, rank, n_stores, n_seen, lowest_ever FROM r JOIN summary USING (product_id) JOIN h USING (product_id) JOIN part ON p_partkey = r.product_id JOIN supplier ON s_suppkey = r.store_id""")
def product_page(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 for all products at once: a page's id is an ordinary filter on the result."""
    own = bare_offers(spark, sf)
    ranked = market.offer_ranks(own).select("product_id", "store_id", "price", "rank")
    summary = market.offer_summary(own).select("product_id", "n_stores")
    seen = observations(spark, sf).groupBy("product_id").agg(F.count("*").alias("n_seen"), F.min("price").alias("lowest_ever"))
    return ranked.join(summary, "product_id").join(seen, "product_id").join(products(spark, sf).select("product_id", "name"), "product_id").join(stores(spark, sf).select("store_id", "store"), "store_id").drop("store_id")
