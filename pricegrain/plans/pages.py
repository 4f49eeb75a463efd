"""Whole pages and passes: front page deals, product page, orders of opportunities, a watch pass, the watch list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.functions import money, parse, sql
from pricegrain.operators import changes, history, market, resolve, search
from pricegrain.operators.storage import scratch
from pricegrain.plans.base import BASE, bare_offers, observations, products, stores, table
from pricegrain.plans.changes import _EVENTS, _WATCH, feed
from pricegrain.plans.registry import query
from pricegrain.sources import catalogue

_SAVED = BASE + """, m AS (SELECT product_id, count(DISTINCT store_id) AS n, median(price) AS med, min(price) AS best, arg_min(units, (price, offer_id)) AS u, arg_min(confidence, (price, offer_id)) AS c, arg_min(store_id, (price, offer_id)) AS best_store FROM offer WHERE available GROUP BY 1),
s AS (SELECT product_id, best, best_store, med - best AS saving, (med - best) / med * 100 AS percent, CASE WHEN u > 0 AND c >= 0.7 THEN best / u END AS unit FROM m WHERE n >= 2 AND med > best)"""


@query(_SAVED + """ SELECT 'amount' AS asked, product_id FROM (SELECT product_id FROM s ORDER BY saving DESC, product_id LIMIT 24) UNION ALL SELECT 'percent', product_id FROM (SELECT product_id FROM s ORDER BY percent DESC, product_id LIMIT 24)
UNION ALL SELECT 'unit', product_id FROM (SELECT product_id FROM s ORDER BY unit NULLS LAST, product_id LIMIT 24)""")
def opportunity_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The first by amount, by share and by unit price."""
    own = bare_offers(spark, sf)
    ask = lambda order: market.opportunities(own, order=order).select(F.lit(order).alias("asked"), "product_id")
    return ask("amount").unionByName(ask("percent")).unionByName(ask("unit"))


@query(_SAVED + """ SELECT product_id, '★ ' || p_name || ': $' || translate(format('{:,}', CAST(round(CAST(best AS DECIMAL(18, 2)), 0) AS BIGINT)), ',.', '.,') || ' in ' || s_name || ' (−$' || translate(format('{:,}', CAST(round(CAST(round(saving, 2) AS DECIMAL(18, 2)), 0) AS BIGINT)), ',.', '.,') || ', ' || CAST(round(round(percent, 6), 0) AS INT) || ' %)' AS line
FROM s JOIN part ON p_partkey = product_id JOIN supplier ON s_suppkey = best_store""")
def saving_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for every opportunity."""
    found = market.opportunities(bare_offers(spark, sf), top=None).join(products(spark, sf).select("product_id", "name"), "product_id").join(stores(spark, sf).select(F.col("store_id").alias("best_store"), "store"), "best_store")
    return found.select("product_id", money.saving_line("name", "store", "best_price", money.rounded("saving", 2), money.rounded("saving_percent", 6)).alias("line"))


@query(_EVENTS + """, d AS (SELECT product_id, max(old_price - new_price) AS amount FROM feed WHERE type = 'price_drop' AND created_at >= TIMESTAMP '1997-01-01' GROUP BY 1), drops AS (SELECT product_id, row_number() OVER (ORDER BY amount DESC, product_id) AS position FROM d ORDER BY amount DESC, product_id LIMIT 3),
f AS (SELECT product_id, round((max(price) - min(price)) / max(price) * 100, 6) AS discount FROM offer WHERE available GROUP BY 1 HAVING count(DISTINCT store_id) >= 2), filler AS (SELECT product_id, row_number() OVER (ORDER BY discount DESC, product_id) AS position FROM f WHERE product_id NOT IN (SELECT product_id FROM drops))
SELECT product_id, 'drop' AS part, 'mixed' AS source FROM drops UNION ALL SELECT product_id, 'spread', 'mixed' FROM filler WHERE position <= 8 - (SELECT count(*) FROM drops)""")
def front_deals(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest drops, topped up with what differs most between shops."""
    drops = history.daily_deals(feed(spark, sf), F.lit("1997-01-01").cast("timestamp"), 3)
    spread = bare_offers(spark, sf).filter("available").groupBy("product_id").agg(F.count_distinct("store_id").alias("n"), F.min("price").alias("low"), F.max("price").alias("high")).filter("n >= 2")
    return search.front_deals(drops, spread.withColumn("discount", F.round(money.discount_percent("low", "high"), 6)), 8).select("product_id", "part", "source")


@query(BASE + """, h AS (SELECT product_id, min(price) AS lowest_ever, max(price) AS highest_ever, round(avg(price), 6) AS mean_ever, count(*) AS points FROM observation GROUP BY 1),
b AS (SELECT product_id, coalesce(min(price) FILTER (available), min(price)) AS best FROM offer GROUP BY 1)
SELECT o.product_id, o.name, s_name AS store, o.price, row_number() OVER (PARTITION BY o.product_id ORDER BY available DESC, o.price, offer_id) AS rank, CASE WHEN units > 0 AND confidence >= 0.7 THEN round(o.price / units, 6) END AS unit_price, best AS best_price, o.price = best AS is_best,
  round(o.price - best, 6) AS over_amount, lowest_ever, highest_ever, mean_ever, points FROM offer o JOIN b USING (product_id) JOIN h USING (product_id) JOIN supplier ON s_suppkey = store_id""")
def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Offers with their place, unit price and distance from the best price that can be had (the best of all where none
    can), and the product's history."""
    own = bare_offers(spark, sf)
    ranked = market.offer_ranks(own).withColumns({"unit_price": F.round(market.unit_price(), 6), "best_price": F.col("reference"), "over_amount": F.round("over_amount", 6)})
    seen = observations(spark, sf).groupBy("product_id").agg(F.min("price").alias("lowest_ever"), F.max("price").alias("highest_ever"), F.round(F.avg("price"), 6).alias("mean_ever"), F.count("*").alias("points"))
    named = ranked.join(products(spark, sf).select("product_id", "name"), "product_id").join(seen, "product_id").join(stores(spark, sf).select("store_id", "store"), "store_id")
    return named.select("product_id", "name", "store", "price", "rank", "unit_price", "best_price", "is_best", "over_amount", "lowest_ever", "highest_ever", "mean_ever", "points")


@query("""SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND event_type IN ('click', 'purchase') AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50)""")
def pending_count(spark: SparkSession, sf: str) -> DataFrame:
    """What was told are the events above a value."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("type"), "value")
    newest = e.agg(F.max("created_at")).first()[0]
    return changes.pending_count(e, e.filter("value > 50"), F.lit(newest) - F.expr("INTERVAL '48' HOUR"), ["click", "purchase"])


@query(_WATCH.replace("row_number() OVER v AS nth", "row_number() OVER v AS nth, count(*) OVER (PARTITION BY user_id) AS total").rsplit("SELECT user_id", 1)[0] + """SELECT CAST(user_id AS VARCHAR) AS url, event, price FROM k WHERE event IS NOT NULL AND nth = total AND NOT (user_id % 4 = 0 AND event = 'purchasable')""")
def watched_once(spark: SparkSession, sf: str) -> DataFrame:
    """Users are pages; each one's last state is read, the one before is known; some events were told before."""
    t, w = F.col("event_type"), W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    stock = F.when(t == "click", "in_stock").when(t == "view", "preorder").when(t == "purchase", "out_of_stock").otherwise("unknown")
    states = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("url"), "user_id", F.when(t == "error", 404).otherwise(200).alias("http_status"), stock.alias("stock_status"), F.col("value").alias("price"), F.row_number().over(w).alias("n"))
    read, known = states.filter("n = 1").drop("n"), states.filter("n = 2").drop("n")
    told = read.filter("user_id % 4 = 0").select("url", F.lit("purchasable").alias("event"), "price")
    return changes.watch_pass(read, known, told)[0].select("url", "event", "price")


@query("""SELECT 'https://shop.example/p/' || p_size || CASE WHEN p_size % 2 = 0 THEN '?variant=' || p_size ELSE '' END AS url, min(p_partkey) AS p_partkey FROM part GROUP BY p_size""")
def watch_list(spark: SparkSession, sf: str) -> DataFrame:
    """One entry for each address that means the same page, the first one given."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    base = F.concat(F.lit("https://shop.example/p/"), size)
    variant = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("variant="), size)).otherwise("")
    given = F.concat(base, F.when(n % 3 == 0, "/").otherwise(""), F.lit("?ref="), n.cast("string"), F.lit("&"), variant, F.when(n % 2 == 0, "#top").otherwise(""))
    return parse.first_of_page(table(spark, sf, "part").select(n, given.alias("url")), "url", "p_partkey")


@query(BASE + """, i AS (SELECT product_id, offer_id, CASE WHEN units % 3 = 0 THEN '' WHEN units % 3 = 1 THEN 'i' || offer_id END AS image FROM offer) SELECT p.product_id, i.image FROM (SELECT DISTINCT product_id FROM offer) p LEFT JOIN (SELECT product_id, arg_min(image, offer_id) AS image FROM i WHERE image <> '' GROUP BY 1) i USING (product_id)""")
def first_images(spark: SparkSession, sf: str) -> DataFrame:
    """A4: some offers have no image or an empty one."""
    image = F.when(F.col("units") % 3 == 0, "").when(F.col("units") % 3 == 1, F.concat(F.lit("i"), F.col("offer_id").cast("string")))
    return market.first_image(bare_offers(spark, sf).withColumn("image", image), "product_id", "image", "offer_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN string_split(p_name, ' ') ELSE ['t', p_brand] END AS tokens, 's' || p_size % 5 || '::' || CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_partkey ELSE 'http://s/' || p_partkey END AS stable_key,
  list_distinct(CASE WHEN p_partkey % 4 = 0 THEN ['g' || p_size] WHEN p_partkey % 4 = 1 THEN ['g' || p_size, 'g0'] ELSE [] END).list_sort() AS gtins, CASE WHEN p_partkey % 4 = 2 THEN ['m' || p_size] ELSE [] END AS mpns FROM part WHERE p_partkey % 10 <> 0""")
def loaded_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the offers have no list of tokens, or a broken or empty one; a tenth is not active."""
    n, size, none = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    broken = F.when(n % 3 == 0, none).when(n % 3 == 1, "[]").otherwise("nonsense")
    p = table(spark, sf, "part")
    own = p.select(
        n.alias("id"), (size % 5).alias("store_id"), F.when(n % 2 == 0, F.concat(F.lit("x"), n)).alias("external_id"), F.concat(F.lit("http://s/"), n).alias("url"), F.col("p_name").alias("name"), F.when(n % 2 == 0, "").otherwise(F.col("p_name")).alias("normalized_name"),
        F.when(size % 3 == 0, broken).otherwise(F.to_json(F.array(F.lit("t"), "p_brand"))).alias("tokens"), none.alias("name_key"), (n % 10 != 0).alias("is_active"), F.lit(None).cast("double").alias("quantity_confidence"),
        *(none.alias(c) for c in ("game", "set_code", "product_type", "language")), F.lit(None).cast("int").alias("units_total"),
    )
    shops = own.select("store_id").distinct().withColumn("store_code", F.concat(F.lit("s"), "store_id"))
    code = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("normalized_value"))
    mine = F.when(n % 4 == 0, F.array(code("gtin", F.concat(F.lit("g"), size)), code("sku", F.lit("no")))).when(n % 4 == 1, F.array(code("gtin", F.concat(F.lit("g"), size)), code("gtin", F.lit("g0")), code("gtin", F.lit("g0")))).when(n % 4 == 2, F.array(code("mpn", F.concat(F.lit("m"), size))))
    return resolve.load_candidates(own, shops, p.select(n.alias("offer_id"), F.explode(mine).alias("i")).select("offer_id", "i.*")).select("id", "tokens", "stable_key", "gtins", "mpns")


@query("""SELECT s_suppkey, CASE WHEN n_nationkey IS NULL OR n_nationkey % 5 = 4 THEN 'none' ELSE n_name END AS platform, CASE WHEN n_nationkey IS NULL OR n_nationkey % 5 = 4 OR n_nationkey % 2 = 1 THEN 10 ELSE n_regionkey END AS max_pages FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def shop_files(spark: SparkSession, sf: str) -> DataFrame:
    """A settings file for each nation, read and looked up by code; some files are broken, some leave a value out."""
    n = table(spark, sf, "nation")
    code = F.concat(F.lit("n"), F.col("n_nationkey"))
    text = F.when(F.col("n_nationkey") % 5 == 4, "not { json").otherwise(F.to_json(F.struct(code.alias("code"), F.col("n_name").alias("platform"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("int")).alias("max_pages"))))
    root = f"{scratch(spark)}/shops-{uuid.uuid4().hex}"
    n.select(code.alias("file"), F.regexp_replace(text, ",", ",\n  ").alias("value")).write.partitionBy("file").text(root)
    found = catalogue.read_files(spark, root, "code string, platform string, max_pages int", glob="*.txt")
    shops = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey")).alias("code"))
    return catalogue.with_settings(shops, found, "code", ["platform", "max_pages"], {"platform": "none", "max_pages": 10}).select("s_suppkey", "platform", F.col("max_pages").cast("long").alias("max_pages"))


@query(BASE + """, o AS (SELECT product_id, count(*) AS n, round(sum(CASE WHEN units > 0 AND confidence >= 0.7 THEN price / units END), 4) AS unit_prices, round(max(greatest((high - price) / high * 100, 0)), 6) AS discount FROM (SELECT *, max(price) OVER (PARTITION BY product_id) AS high FROM offer) GROUP BY 1)
SELECT * FROM o""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The library's functions from SQL."""
    sql.register(spark)
    bare_offers(spark, sf).createOrReplaceTempView("pg_offers")
    return spark.sql("""SELECT product_id, count(*) AS n, round(sum(pg_unit_price(price, units, confidence)), 4) AS unit_prices, round(max(pg_discount_percent(price, high)), 6) AS discount
      FROM (SELECT *, max(price) OVER (PARTITION BY product_id) AS high FROM pg_offers) GROUP BY product_id""")


@query(r"""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS position, regexp_extract(url, '^[a-z]+://[^/?#]+') || unnest(l) AS link FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def sql_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """A table function from SQL: every link of every page, absolute."""
    sql.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("pg_pages")
    return spark.sql("SELECT page_id, position, pg_absolute_url(url, value) AS link FROM pg_pages, LATERAL pg_page_links(html, 'a', 'href')")
