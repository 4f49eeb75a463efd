"""Filters, joins, orders and pages over the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import market, search
from pricegrain.plans.base import BASE, bare_offers, offers, products, stores, table
from pricegrain.plans.registry import query

_S = BASE + """, s AS (SELECT product_id, count(DISTINCT store_id) AS n_stores, count(*) FILTER (available) AS n_available, min(price) AS best_price, min(price) FILTER (available) AS best_available, max(price) AS worst, max(seen_at) AS last_seen FROM offer GROUP BY 1),
p AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS type, CASE WHEN p_size % 3 = 0 THEN 'en' END AS language, n_stores, n_available, best_price, best_available, coalesce(best_available, best_price) AS price, worst, last_seen FROM part JOIN s ON product_id = p_partkey)"""


def catalogue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = bare_offers(spark, sf)
    found = own.groupBy("product_id").agg(
        F.count_distinct("store_id").alias("n_stores"), F.count_if("available").alias("n_available"), F.min("price").alias("best_price"), F.min(F.when(F.col("available"), F.col("price"))).alias("best_available"),
        F.max("price").alias("worst"), F.max("seen_at").alias("last_seen"),
    )
    p = products(spark, sf).withColumn("language", F.when(F.col("size") % 3 == 0, "en")).drop("size").join(found, "product_id")
    return p.withColumn("price", F.coalesce("best_available", "best_price")), own.join(products(spark, sf).select("product_id", "name"), "product_id")


def _short(df: DataFrame) -> DataFrame:
    return df.select("product_id", "name", "brand", "price", "n_stores")


@query(_S + " SELECT product_id, name, brand, price, n_stores FROM p WHERE brand = 'Brand#12' AND n_available > 0 AND n_stores >= 2 AND price BETWEEN 1000 AND 60000 AND language IS NULL")
def filtered_products(spark: SparkSession, sf: str) -> DataFrame:
    p, o = catalogue(spark, sf)
    return _short(search.search(p, o, brand="Brand#12", in_stock=True, min_stores=2, low=1000, high=60000, language="unknown"))


@query(_S + " SELECT product_id, name, brand, price, n_stores FROM p WHERE (name ILIKE '%small%' OR EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.product_id AND o.name ILIKE '%small%')) AND (name ILIKE '%ol%' OR EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.product_id AND o.name ILIKE '%ol%'))")
def search_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    p, o = catalogue(spark, sf)
    return _short(search.search(p, o, tokens=["Small", "ol"]))


@query(_S + " SELECT product_id, name, brand, price, n_stores FROM p WHERE type IN (SELECT DISTINCT p_type FROM part WHERE p_size <= 10) AND EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.product_id AND o.store_id = 7)")
def exists_store(spark: SparkSession, sf: str) -> DataFrame:
    p, o = catalogue(spark, sf)
    members = products(spark, sf).filter("size <= 10").select("type").distinct()
    return _short(search.search(p, o, store=7).join(members, "type", "left_semi"))


@query(_S + " SELECT product_id, name, brand, price, n_stores, (SELECT count(*) FROM p) AS total, (SELECT greatest(1, ceil(count(*) / 25.0)) FROM p) AS pages FROM p ORDER BY price DESC NULLS LAST, product_id LIMIT 25 OFFSET 50")
def paging(spark: SparkSession, sf: str) -> DataFrame:
    p, _ = catalogue(spark, sf)
    return search.page(_short(p), 3, 25, "price_desc")


_ORDER_SQL = {"relevance": "score DESC", "price_asc": "price", "price_desc": "price DESC", "name": "name", "stores": "n_stores DESC", "updated": "last_seen DESC", "new": "product_id DESC", "discount": "discount DESC"}


@query(_S + ", d AS (SELECT *, (worst - price) / worst * 100 AS discount, length(name) AS score FROM p), " + ", ".join(f"o{i} AS (SELECT '{k}' AS ordering, product_id, row_number() OVER (ORDER BY {v} NULLS LAST, product_id) AS nth FROM d ORDER BY nth LIMIT 10)" for i, (k, v) in enumerate(_ORDER_SQL.items())) + " " + " UNION ALL ".join(f"SELECT ordering, product_id FROM o{i}" for i in range(8)))
def orders(spark: SparkSession, sf: str) -> DataFrame:
    """O1: the first ten of each order."""
    p, _ = catalogue(spark, sf)
    rows = p.withColumns({"discount": (F.col("worst") - F.col("price")) / F.col("worst") * 100, "score": F.length("name")})
    out = None
    for k in search.ORDERS:
        own = search.ordered(rows, k).limit(10).select(F.lit(k).alias("ordering"), "product_id")
        out = own if out is None else out.unionByName(own)
    return out


@query(BASE + " SELECT offer_id, CASE stock_status WHEN 'in_stock' THEN 'In stock' WHEN 'preorder' THEN 'Pre-order' ELSE stock_status END AS label, stock_status IN ('in_stock', 'preorder') AS open, nullif(units, 7) IS NOT DISTINCT FROM nullif(CAST(confidence * 10 AS INT), 7) AS same FROM offer")
def offer_labels(spark: SparkSession, sf: str) -> DataFrame:
    """F10, F13, F14."""
    seven = F.lit(7)
    return bare_offers(spark, sf).select(
        "offer_id", search.labelled("stock_status", {"in_stock": "In stock", "preorder": "Pre-order"}).alias("label"), F.col("available").alias("open"),
        F.nullif("units", seven).eqNullSafe(F.nullif(F.round(F.col("confidence") * 10).cast("int"), seven)).alias("same"),
    )


@query("SELECT p_partkey AS product_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def anti_orphans(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("product_id"))
    return products(spark, sf).select("product_id").join(returned, "product_id", "left_anti")


@query(BASE + """ SELECT o.product_id, p_name AS name, s_name AS store, n_name AS nation, r_name AS region, price, f.user_id IS NOT NULL AS favourite FROM offer o JOIN part ON p_partkey = o.product_id JOIN supplier ON s_suppkey = o.store_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') f ON f.user_id = o.product_id WHERE o.available""")
def star_join(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions join by the size that statistics give them."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region_id"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))
    liked = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("product_id")).distinct().withColumn("_f", F.lit(True))
    shops = stores(spark, sf).join(nation, "nation_id").join(region, "region_id").select("store_id", "store", "nation", "region")
    return offers(spark, sf).filter("available").join(shops, "store_id").join(liked, "product_id", "left").select("product_id", "name", "store", "nation", "region", "price", F.col("_f").isNotNull().alias("favourite"))


@query(BASE + ", best AS (SELECT product_id, arg_min(store_id, (price, offer_id)) AS best_store, arg_max(store_id, (price, -offer_id)) AS worst_store FROM offer GROUP BY 1) SELECT product_id, a.s_name AS best_store, b.s_name AS worst_store FROM best LEFT JOIN supplier a ON a.s_suppkey = best_store LEFT JOIN supplier b ON b.s_suppkey = worst_store")
def twice_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same dimension twice; the cheapest offer as an aggregate, not a correlated query."""
    best = bare_offers(spark, sf).groupBy("product_id").agg(F.min_by("store_id", F.struct("price", "offer_id")).alias("x"), F.max_by("store_id", F.struct("price", F.negative("offer_id"))).alias("y"))
    names = stores(spark, sf)
    a, b = names.select(F.col("store_id").alias("x"), F.col("store").alias("best_store")), names.select(F.col("store_id").alias("y"), F.col("store").alias("worst_store"))
    return best.join(a, "x", "left").join(b, "y", "left").select("product_id", "best_store", "worst_store")


@query("""SELECT event_id, user_id, coalesce(a.p_name, b.p_name) AS name, a.p_partkey IS NOT NULL AS by_id FROM events LEFT JOIN part a ON a.p_partkey = event_id LEFT JOIN part b ON b.p_partkey = user_id""")
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """By one key, else by another."""
    names = products(spark, sf)
    a, b = names.select(F.col("product_id").alias("event_id"), F.col("name").alias("a")), names.select(F.col("product_id").alias("user_id"), F.col("name").alias("b"))
    return table(spark, sf, "events").join(a, "event_id", "left").join(b, "user_id", "left").select("event_id", "user_id", F.coalesce("a", "b").alias("name"), F.col("a").isNotNull().alias("by_id"))


@query("""WITH o AS (SELECT p_partkey, 'https://s.test/p/' || p_size || CASE WHEN p_partkey % 3 > 0 THEN '#v' || p_partkey ELSE '' END AS url FROM part), w AS (SELECT DISTINCT 'https://s.test/p/' || l_quantity::INT AS page FROM lineitem)
SELECT p_partkey, page FROM o JOIN w ON page = url OR starts_with(url, page || '#')""")
def same_page(spark: SparkSession, sf: str) -> DataFrame:
    """Offers and the watched pages they stand on: an address is the page's, or the page's and an anchor."""
    from pricegrain.functions.parse import url_base

    page = lambda c: F.concat(F.lit("https://s.test/p/"), F.col(c).cast("int").cast("string"))
    anchor = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("#v"), F.col("p_partkey").cast("string"))).otherwise("")
    own = table(spark, sf, "part").select("p_partkey", F.concat(page("p_size"), anchor).alias("url")).withColumn("page", url_base("url"))
    return own.join(table(spark, sf, "lineitem").select(page("l_quantity").alias("page")).distinct(), "page").select("p_partkey", "page")


@query(BASE + """, deals AS (SELECT product_id, row_number() OVER (ORDER BY (max(price) - min(price)) DESC, product_id) AS position FROM offer WHERE available GROUP BY product_id HAVING count(*) > 1 ORDER BY position LIMIT 12),
filler AS (SELECT product_id, row_number() OVER (ORDER BY min(price), product_id) AS position FROM offer GROUP BY product_id ORDER BY position LIMIT 24)
SELECT product_id FROM (SELECT 0 AS part, * FROM deals UNION ALL SELECT 1, * FROM filler WHERE product_id NOT IN (SELECT product_id FROM deals)) ORDER BY part, position LIMIT 20""")
def topped_up_deals(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = bare_offers(spark, sf)
    nth = lambda df, *order: df.orderBy(*order).limit(24).withColumn("position", F.row_number().over(W.orderBy(*order)))
    deals = own.filter("available").groupBy("product_id").agg((F.max("price") - F.min("price")).alias("spread"), F.count("*").alias("n")).filter("n > 1")
    filler = own.groupBy("product_id").agg(F.min("price").alias("low"))
    return search.topped_up(nth(deals, F.desc("spread"), "product_id").filter("position <= 12").select("product_id", "position"), nth(filler, "low", "product_id").select("product_id", "position"), "product_id", 20).select("product_id")


@query("""SELECT user_id, count(*) AS views, max(ts) AS last_view FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY views DESC, last_view DESC, user_id LIMIT 20""")
def most_viewed(spark: SparkSession, sf: str) -> DataFrame:
    from pricegrain.operators.storage import count_views

    return count_views(table(spark, sf, "events").filter("event_type = 'view'"), "user_id", "ts").orderBy(F.desc("views"), F.desc("last_view"), "user_id").limit(20)


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id, turn DESC")
def comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text").orderBy("conv_id", F.desc("turn"))


@query("""WITH w AS (SELECT p_brand || '/' || p_type || '/' || p_size AS family, p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), e AS (SELECT family, min(w) AS lo, max(w) AS hi FROM w GROUP BY 1),
c AS (SELECT family, coalesce((SELECT min(i) - 1 FROM range(1, 1 + greatest(len(lo), len(hi))) t(i) WHERE lo[i] IS DISTINCT FROM hi[i]), len(lo)) AS n FROM e)
SELECT family, p_partkey, coalesce(nullif(array_to_string(w[n + 1:], ' '), ''), p_name) AS tail FROM w JOIN c USING (family)""")
def distinctive_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one brand, type and size are a family."""
    family = F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("family")
    return search.distinctive_tail(table(spark, sf, "part").select(family, "p_partkey", "p_name"), "family", "p_name").select("family", "p_partkey", "tail")


@query()
def random_highlight(spark: SparkSession, sf: str) -> DataFrame:
    top = market.opportunities(bare_offers(spark, sf), top=24)
    return search.random_pick(top, [F.desc("saving"), F.col("product_id")], 6, seed=7)


@query("""SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE abs(p_retailprice - (900 + p_partkey % 100)) <= greatest(1, 0.02 * p_retailprice) END AS equal FROM part""")
def within_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """F20."""
    price = F.when(F.col("p_size") != 7, F.col("p_retailprice"))
    return table(spark, sf, "part").select("p_partkey", (F.abs(price - (900 + F.col("p_partkey") % 100)) <= F.greatest(F.lit(1), 0.02 * price)).alias("equal"))


@query("SELECT 'all' AS asked, event_id, user_id FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20) UNION ALL SELECT 'one', event_id, user_id FROM (SELECT * FROM events WHERE event_type = 'error' AND user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20)")
def newest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: the newest errors of all shops, and of one."""
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    ask = lambda asked, store: search.newest(errors, "ts", "event_id", 20, store, "user_id").select(F.lit(asked).alias("asked"), "event_id", "user_id")
    return ask("all", None).unionByName(ask("one", 3))
