"""Decisions and corrections by hand, gates of messages, lists of the keepers, texts and terms: each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import money, parse
from pricegrain.operators import changes, resolve, search, storage
from pricegrain.plans.base import BASE, bare_offers, products, spread, stores, table
from pricegrain.plans.registry import query
from pricegrain.sources import feeds, html, tables


def _cases(on: Column, *values: Column | str | float | None) -> Column:
    """The value whose number is the remainder of on; null for None."""
    out = F.lit(None)
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(on % len(values) == i, v).otherwise(out)
    return out


def _key(c: Column | str) -> Column:
    return F.concat(F.lit("k"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# amounts, times and texts


@query("""SELECT p_partkey, round(CASE p_size % 4 WHEN 2 THEN 20.0 WHEN 3 THEN 0 ELSE 0 END, 6) AS discount FROM part""")
def discount_percents(spark: SparkSession, sf: str) -> DataFrame:
    """Without a worst price, with 0, with a quarter more than the best, with less."""
    best = F.col("p_retailprice")
    worst = _cases(F.col("p_size"), None, F.lit(0.0), best * 1.25, best * 0.8)
    return table(spark, sf, "part").select("p_partkey", F.round(money.discount_percent(best, worst), 6).alias("discount"))


@query("SELECT event_id, strftime(timezone('America/Santiago', timezone('UTC', ts)), '%d-%m-%Y') AS local_date FROM events")
def local_dates(spark: SparkSession, sf: str) -> DataFrame:
    """E42."""
    return table(spark, sf, "events").select("event_id", money.local_date(F.col("ts").cast("timestamp")).alias("local_date"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events), s AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-09 12:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM e)
SELECT event_id, CASE WHEN s IS NULL THEN 'never' WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' WHEN s < 2592000 THEN (s // 86400) || ' d' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM s""")
def ages(spark: SparkSession, sf: str) -> DataFrame:
    """A seventh of the events have no time."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("t"))
    return e.select("event_id", money.ago("t", _at("2024-01-09 12:00:00")).alias("age"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN TIMESTAMP '2024-01-05 10:20:30' + to_days(p_size) WHEN 1 THEN TIMESTAMP '2024-01-05 10:20:30' + to_days(p_size) WHEN 2 THEN timezone('UTC', timezone('America/Santiago', TIMESTAMP '2024-03-01 23:59:59' + to_days(p_size % 28)))
  WHEN 3 THEN timezone('UTC', timezone('America/Santiago', TIMESTAMP '2024-07-01 23:59:59' + to_days(p_size % 28))) END AS ends FROM part""")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Days, with and without a word, dates in two of the forms, words, nothing."""
    size, two = F.col("p_size").cast("string"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")
    raw = _cases(F.col("p_partkey"), size, F.concat(F.lit(" "), size, F.lit(" Days ")), F.concat(F.lit("2024-03-"), two), F.concat(two, F.lit("/07/2024")), F.lit("soon"), None)
    return table(spark, sf, "part").select("p_partkey", money.parse_term(raw, _at("2024-01-05 10:20:30")).alias("ends"))


_STATES = ["http://schema.org/InStock", "Pre-Order", "Out of stock, backorder later", "SOLD OUT", "LimitedAvailability", "ask us", None, "https://schema.org/InStoreOnly", "PREVENTA", "Online Only", "Discontinued / in stock"]


@query("SELECT event_id, ['in_stock', 'preorder', 'preorder', 'out_of_stock', 'in_stock', 'unknown', 'unknown', 'in_stock', 'preorder', 'in_stock', 'out_of_stock'][1 + user_id % 11] AS status FROM events")
def availability_words(spark: SparkSession, sf: str) -> DataFrame:
    """Declared states in several spellings."""
    raw = _cases(F.col("user_id"), *(s and F.lit(s) for s in _STATES))
    return table(spark, sf, "events").select("event_id", parse.availability(raw).alias("status"))


@query("""SELECT p_partkey, 'https://shop.example/p/' || p_partkey || CASE p_partkey % 4 WHEN 1 THEN '?variant=' || p_size WHEN 2 THEN '?variant=' || p_size ELSE '' END AS url FROM part""")
def variant_urls(spark: SparkSession, sf: str) -> DataFrame:
    """All parameters go but the variant's."""
    base, v = F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string")
    raw = _cases(F.col("p_partkey"), F.concat(base, F.lit("/?ref=x#top")), F.concat(base, F.lit("?variant="), v), F.concat(base, F.lit("/?a=1&variant="), v, F.lit("&b=2#c")), F.concat(base, F.lit("?myvariant=3")))
    return table(spark, sf, "part").select("p_partkey", parse.variant_url(raw).alias("url"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root, regexp_extract(url, '^[^?#]*/') AS folder FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://other.example/a' WHEN 1 THEN root || '/deals' WHEN 2 THEN folder || 'next' WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '?page=9' END AS url FROM p""")
def absolute_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every kind as the pages mean them; scripts and anchors are none."""
    href = _cases(F.col("page_id"), *map(F.lit, ["https://other.example/a", " /deals ", "next", "?page=9", "javascript:go()", "#top"]))
    return table(spark, sf, "pages").select("page_id", parse.absolute_url("url", href).alias("url"))


@query("""SELECT conv_id, turn, sha256(replace(text, ' ', ' <b>"é''& ')) AS text_sha256 FROM conversations""")
def unescaped(spark: SparkSession, sf: str) -> DataFrame:
    """Named and numbered references."""
    raw = F.replace("text", F.lit(" "), F.lit(" &lt;b&gt;&quot;&eacute;&#39;&amp; "))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(parse.unescape(raw), 256).alias("text_sha256"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 8 < 6 THEN CAST(1000 + p_size AS DOUBLE) END AS price FROM part")
def meta_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The declarations of a price; one that is no number gives way; prices in scripts and of other names are none."""
    v = (1000 + F.col("p_size")).cast("string")
    page = _cases(
        F.col("p_partkey"), F.concat(F.lit('<meta property="og:price:amount" content="'), v, F.lit('">')), F.concat(F.lit('<meta content="'), v, F.lit('"  property="price:amount">')),
        F.concat(F.lit('<meta property="og:price:amount" content="ask"><i itemprop="price" class="x" content="'), v, F.lit('">')), F.concat(F.lit('<meta property="price:amount" content="9"><meta property="tiendanube:price" content="'), v, F.lit('">')),
        F.concat(F.lit('<script>{"price": "7"}</script><meta property="price:amount" content="'), v, F.lit('">')), F.concat(F.lit('<meta itemprop="price" content="8"><meta property="price:amount" content="'), v, F.lit('">')),
        F.concat(F.lit('<script>{"price": "'), v, F.lit('"}</script>')), F.concat(F.lit('<meta property="product:price:amount" content="'), v, F.lit('">')),
    )
    return table(spark, sf, "part").select("p_partkey", parse.meta_price(page).alias("price"))


@query(BASE + """, r AS (SELECT product_id, arg_min(price, (price, offer_id)) AS price FROM offer GROUP BY 1 ORDER BY product_id LIMIT 12), n AS (SELECT *, row_number() OVER (ORDER BY product_id) AS n FROM r)
SELECT product_id, CASE WHEN n % 3 = 2 THEN 'back_in_stock' ELSE 'price_drop' END AS type, CASE WHEN n % 3 <> 2 THEN round(price / 0.75, 6) END AS old, price AS new FROM n""")
def sample_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to try messages with, a dozen of them: an invented drop of a quarter, every third a restock."""
    from pyspark.sql import Window as W

    top = bare_offers(spark, sf).groupBy("product_id").agg(F.min("price").alias("new")).orderBy("product_id").limit(12)
    restock = F.row_number().over(W.orderBy("product_id")) % 3 == 2  # twelve rows, so one task
    return top.withColumn("_r", restock).select("product_id", F.when(F.col("_r"), "back_in_stock").otherwise("price_drop").alias("type"), F.when(~F.col("_r"), F.round(F.col("new") / 0.75, 6)).alias("old"), "new")


# sources


@query("""SELECT 'https://shop.example/p/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '#' || s ELSE '' END AS url, p_name AS name, s AS sku, CAST(p_size + CASE s WHEN 'a' THEN 0 ELSE 0.5 END AS DOUBLE) AS price, CASE s WHEN 'a' THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status
FROM part, (VALUES ('a'), ('b')) v(s) WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND s = 'a')""")
def page_products(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with two products in a graph, with one beside one of another page, with a broken script."""
    url = F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string"))
    product = lambda sku, extra, state, address=None: F.concat(
        F.lit('{"@type": "Product", "name": "'), F.col("p_name"), F.lit(f'", "sku": "{sku}", "url": "'), address if address is not None else url, F.lit('/?x=1", "offers": [{"price": "'), (F.col("p_size") + extra).cast("decimal(10,1)").cast("string"), F.lit(f'", "availability": "https://schema.org/{state}"}}]}}')
    )
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    two = script(F.lit('{"@graph": ['), product("a", 0, "InStock"), F.lit(", "), product("b", 0.5, "OutOfStock"), F.lit("]}"))
    one = F.concat(script(F.lit('{"@type": "Thing"}')), script(product("a", 0, "InStock")), script(product("z", 9, "InStock", F.lit("https://shop.example/p/other"))))
    pages = spread(table(spark, sf, "part")).select("p_name", url.alias("url"), _cases(F.col("p_partkey"), two, one, script(F.lit('{"@type": "Product", "name": '))).alias("html"))
    return html.ld_products(pages, "html").select("url", "name", "sku", "price", "stock_status")


@query("""WITH a AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT 'u' || k AS url, CASE WHEN k % 2 = 0 THEN 'api' WHEN k % 3 = 0 THEN 'shop' ELSE 'page' END AS name, CAST(CASE WHEN k % 2 = 0 THEN z WHEN k % 3 = 0 THEN z + 1 ELSE z + 2 END AS DOUBLE) AS price,
  CASE WHEN k % 2 = 0 AND z % 2 = 0 THEN 'in_stock' WHEN k % 3 = 0 THEN 'preorder' WHEN k % 5 <> 0 THEN 'out_of_stock' ELSE 'unknown' END AS stock_status FROM a WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 <> 0""")
def fallback_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources that know parts of the pages each; the first's stock is unknown half of the time."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    source = lambda rows, name, extra, stock: rows.select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit(name).alias("name"), (F.col("p_size") + extra).cast("double").alias("price"), stock.alias("stock_status"))
    api = source(p.filter(k % 2 == 0), "api", 0, F.when(F.col("p_size") % 2 == 0, "in_stock").otherwise("unknown"))
    return feeds.merged_sources(api, source(p.filter(k % 3 == 0), "shop", 1, F.lit("preorder")), source(p.filter(k % 5 != 0), "page", 2, F.lit("out_of_stock")))


@query("""SELECT event_id FROM events WHERE event_id % 5 IN (0, 3)""")
def broken_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A payload cut short, one that is no JSON, none, and good ones."""
    raw = _cases(F.col("event_id"), F.lit('{"k": '), F.col("props"), None, F.lit("<html>"), F.lit("[1]"))
    return feeds.bad_payloads(table(spark, sf, "events").select("event_id", raw.alias("payload"))).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000")
def parameterised(spark: SparkSession, sf: str) -> DataFrame:
    """SQL with parameters."""
    return tables.sql(spark, f"SELECT o_orderkey, o_totalprice FROM parquet.`{sf}/orders.parquet` WHERE o_orderstatus = :status AND o_totalprice >= :least", status="O", least=1000)


# decisions by hand

_PAIRS = "WITH d AS (SELECT 'k' || o_custkey AS x, 'k' || o_orderkey % 50 AS y, o_orderkey AS t, o_orderstatus AS s FROM orders), k AS (SELECT least(x, y) AS a_key, greatest(x, y) AS b_key, t, s FROM d)"


def _decided(spark: SparkSession, sf: str, status: str, decision: Column) -> DataFrame:
    rows = table(spark, sf, "orders").filter(F.col("o_orderstatus") == status)
    return rows.select(_key("o_custkey").alias("a_key"), _key(F.col("o_orderkey") % 50).alias("b_key"), decision.alias("decision"), F.col("o_orderkey").alias("decided_at"))


def _old_decisions(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Those of orders that are not finished, or of all."""
    a, b = storage.ordered_pair("a_key", "b_key")
    old = _decided(spark, sf, "O", F.lit("same")).unionByName(_decided(spark, sf, "P", F.lit("same")))
    return (old.unionByName(_decided(spark, sf, "F", F.lit("same"))) if whole else old).groupBy(a.alias("a_key"), b.alias("b_key")).agg(F.lit("same").alias("decision"), F.min("decided_at").alias("decided_at"))


@query(_PAIRS + """, o AS (SELECT a_key, b_key, 'same' AS decision, min(t) AS decided_at FROM k WHERE s <> 'F' GROUP BY 1, 2), n AS (SELECT a_key, b_key, CASE WHEN max(t) % 2 = 0 THEN 'same' ELSE 'different' END AS decision, max(t) AS decided_at FROM k WHERE s = 'F' GROUP BY 1, 2)
SELECT a_key, b_key, coalesce(n.decision, o.decision) AS decision, coalesce(n.decided_at, o.decided_at) AS decided_at FROM o FULL JOIN n USING (a_key, b_key)""")
def saved_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions meet older ones about the same two, in either order."""
    new = _decided(spark, sf, "F", F.when(F.col("o_orderkey") % 2 == 0, "same").otherwise("different"))
    return resolve.save_decisions(_old_decisions(spark, sf), new)


@query(_PAIRS + """, o AS (SELECT DISTINCT a_key, b_key FROM k), i AS (SELECT 'k' || c_custkey AS stable_key, c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0)
SELECT a_key, b_key, 'same' AS decision, a.id AS a, b.id AS b, a.id IS NULL AS a_missing, b.id IS NULL AS b_missing FROM o LEFT JOIN i a ON a.stable_key = a_key LEFT JOIN i b ON b.stable_key = b_key""")
def decided_sides(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the offers are gone."""
    return resolve.decision_sides(_old_decisions(spark, sf, whole=True).drop("decided_at"), _known(spark, sf))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), _key("c_custkey").alias("stable_key"))


@query(_PAIRS + """, o AS (SELECT DISTINCT a_key, b_key FROM k), i AS (SELECT 'k' || c_custkey AS stable_key, c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0)
SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM o JOIN i a ON a.stable_key = a_key JOIN i b ON b.stable_key = b_key WHERE a.id <> b.id""")
def decided_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of offers that decisions 'same' join."""
    return resolve.keyed_pairs(_old_decisions(spark, sf, whole=True), _known(spark, sf), "same")


@query("""WITH g AS (SELECT l_suppkey AS g, min(l_partkey) AS a FROM lineitem GROUP BY 1) SELECT DISTINCT a, l_partkey AS b FROM lineitem JOIN g ON g = l_suppkey WHERE l_partkey <> a""")
def shared_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Offers with their sets of codes; each is joined to the first that has one of them."""
    codes = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_suppkey").alias("gtins"))
    every = products(spark, sf).select(F.col("product_id").alias("id")).join(codes, "id", "left")
    return resolve.gtin_edges(every)


_SIBLINGS = "WITH o AS (SELECT 'k' || p_partkey AS stable_key, p_partkey - p_partkey % 8 AS product_id, p_partkey % 8 = 3 AS split FROM part), d AS (SELECT least(a.stable_key, b.stable_key) AS a_key, greatest(a.stable_key, b.stable_key) AS b_key, 'different' AS decision FROM o a JOIN o b USING (product_id) WHERE a.split AND a.stable_key <> b.stable_key)"


def _siblings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    o = table(spark, sf, "part").select(_key(n).alias("stable_key"), (n - n % 8).alias("product_id"), n)
    return resolve.separate(o.filter("p_partkey % 8 = 3").drop("p_partkey"), o.drop("p_partkey"))


@query(_SIBLINGS + " SELECT a_key, b_key, decision FROM d")
def separated(spark: SparkSession, sf: str) -> DataFrame:
    """An offer of each product is set apart from its siblings."""
    return _siblings(spark, sf)


@query(_SIBLINGS + " SELECT a_key, b_key, decision FROM d WHERE CAST(a_key[2:] AS INT) % 3 <> 0 AND CAST(b_key[2:] AS INT) % 3 <> 0")
def rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """M21d: without the decisions that the offers of every third key take part in."""
    return resolve.rejoin(_siblings(spark, sf), table(spark, sf, "part").filter("p_partkey % 3 = 0").select(_key("p_partkey").alias("stable_key")))


@query("""SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_partkey % 3 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part) THEN 'pending' ELSE 'confirmed' END AS status FROM part""")
def reopened(spark: SparkSession, sf: str) -> DataFrame:
    """M21e, M21f: reviews whose decision is forgotten wait again; every second decision names its keys the other way round."""
    n = F.col("p_partkey")
    p = table(spark, sf, "part")
    turned = n % 2 == 0
    decisions = p.select(_key(F.when(turned, n + 1).otherwise(n)).alias("a_key"), _key(F.when(turned, n).otherwise(n + 1)).alias("b_key"), F.lit("same").alias("decision"), n)
    queue = p.select(n.alias("a"), (n + 1).alias("b"), F.lit("confirmed").alias("status"))
    return resolve.forget_decisions(decisions, queue, p.select(n.alias("id"), _key(n).alias("stable_key")), decisions.filter("p_partkey % 3 = 0"))[1]


_QUEUE = "WITH q AS (SELECT p_partkey AS a, p_partkey + 1 AS b, CAST(p_size AS DOUBLE) AS score, ['pending', 'confirmed', 'rejected'][1 + p_partkey % 3] AS status FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part))"


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    p, n = table(spark, sf, "part"), F.col("p_partkey")
    both = p.join(p.select((n - 1).alias("p_partkey")), "p_partkey", "left_semi")
    return both.select(n.alias("a"), (n + 1).alias("b"), F.col("p_size").cast("double").alias("score"), _cases(n, F.lit("pending"), F.lit("confirmed"), F.lit("rejected")).alias("status"))


@query(_QUEUE + """, f AS (SELECT a, b, score + 1 AS score FROM q WHERE a % 4 <> 1), kept AS (SELECT * FROM q WHERE status <> 'pending' AND a - a % 10 <> b - b % 10 AND a % 7 <> 0 AND b % 7 <> 0)
SELECT * FROM kept UNION ALL SELECT a, b, score, 'pending' FROM f ANTI JOIN kept USING (a, b)""")
def synced_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A queue meets what a new run found; tens are groups, and offers with numbers of seven are gone."""
    q, n = _reviews(spark, sf), F.col("p_partkey")
    p = table(spark, sf, "part")
    found = q.filter("a % 4 <> 1").withColumn("score", F.col("score") + 1).drop("status")
    return resolve.sync_reviews(q, found, p.select(n.alias("id"), (n - n % 10).alias("product_key")), p.filter("p_partkey % 7 <> 0").select(n.alias("id")))


@query(_QUEUE + " SELECT a, b, score, CASE WHEN status = 'pending' AND a % 4 IN (0, 1) THEN 'confirmed' ELSE status END AS status FROM q")
def implied_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Three of each four offers are decided to be the same."""
    n = F.col("p_partkey")
    same = table(spark, sf, "part").filter("p_partkey % 4 IN (1, 2)").select((n - n % 4).alias("a"), n.alias("b"))
    return resolve.close_implied(_reviews(spark, sf), same)


# corrections by hand

_OVERRIDES = """WITH o AS (SELECT 'k' || p_partkey AS entity_key, 'language' AS attribute, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'xx' END AS value FROM part WHERE p_size % 5 = 0), c AS (SELECT 'k' || p_partkey AS entity_key, 'language' AS attribute, NULL AS value FROM part WHERE p_size % 10 = 0 UNION ALL
SELECT 'k' || p_partkey, 'product_type', 'T' || p_size FROM part WHERE p_size % 7 = 0 UNION ALL SELECT 'k' || p_partkey, 'url', CASE WHEN p_partkey % 2 = 0 THEN 'https://new.example/' || p_partkey ELSE 'ftp://new.example' END FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'k' || p_partkey, 'price', '1' FROM part WHERE p_size = 4),
v AS (SELECT * FROM c WHERE attribute IN ('language', 'set_code', 'product_type', 'url') AND NOT (attribute = 'url' AND value LIKE 'ftp%')), m AS (SELECT entity_key, attribute, CASE WHEN v.entity_key IS NOT NULL THEN v.value ELSE o.value END AS value FROM o FULL JOIN v USING (entity_key, attribute)), kept AS (SELECT * FROM m WHERE value IS NOT NULL)"""


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    p, size, key = table(spark, sf, "part"), F.col("p_size"), _key("p_partkey").alias("entity_key")
    part = lambda rows, attribute, value: rows.select(key, F.lit(attribute).alias("attribute"), value.cast("string").alias("value"))
    old = part(p.filter(size % 5 == 0), "language", F.when(size % 2 == 0, "").otherwise("xx"))
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" https://new.example/"), F.col("p_partkey").cast("string"))).otherwise("ftp://new.example")
    new = part(p.filter(size % 10 == 0), "language", F.lit(None)).unionByName(part(p.filter(size % 7 == 0), "product_type", F.concat(F.lit("T"), size.cast("string"))))
    return resolve.set_overrides(old, new.unionByName(part(p.filter(size % 3 == 0), "url", url)).unionByName(part(p.filter(size == 4), "price", F.lit("1"))))


@query(_OVERRIDES + " SELECT entity_key, attribute, value FROM kept")
def corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Some are taken back, some are new, some are refused."""
    return _overrides(spark, sf)


@query(_OVERRIDES + """, w AS (SELECT entity_key, max(value) FILTER (attribute = 'language') AS l, max(value) FILTER (attribute = 'product_type') AS t, max(value) FILTER (attribute = 'url') AS u FROM kept GROUP BY 1)
SELECT 'k' || p_partkey AS stable_key, CASE WHEN l IS NOT NULL THEN nullif(l, '') ELSE p_brand END AS language, p_type AS set_code, coalesce(t, p_type) AS product_type, 'u' || p_partkey AS url, coalesce(u, 'u' || p_partkey) AS shown_url FROM part LEFT JOIN w ON entity_key = 'k' || p_partkey""")
def overridden(spark: SparkSession, sf: str) -> DataFrame:
    """J13, M21g: what names say with the corrections over it."""
    own = table(spark, sf, "part").select(_key("p_partkey").alias("stable_key"), F.col("p_brand").alias("language"), F.col("p_type").alias("set_code"), F.col("p_type").alias("product_type"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"))
    return resolve.with_overrides(own, _overrides(spark, sf))


@query(_OVERRIDES + """, n AS (SELECT entity_key, count(*) AS n FROM kept GROUP BY 1) SELECT 'edited' AS asked, p_partkey, n AS n_manual FROM part JOIN n ON entity_key = 'k' || p_partkey WHERE p_name ILIKE '%RED%' OR 'u' || p_partkey ILIKE '%RED%' OR p_type ILIKE '%RED%'
UNION ALL SELECT 'unknown', p_partkey, coalesce(n, 0) FROM part LEFT JOIN n ON entity_key = 'k' || p_partkey WHERE p_size % 2 = 0 UNION ALL SELECT 'shop', p_partkey, coalesce(n, 0) FROM part LEFT JOIN n ON entity_key = 'k' || p_partkey WHERE p_partkey % 10 = 3 AND p_size % 2 = 1 AND p_brand = 'Brand#7'""")
def admin_offers(spark: SparkSession, sf: str) -> DataFrame:
    """by text and edited, without a language, of a shop and a language."""
    n, over = F.col("p_partkey"), _overrides(spark, sf)
    own = table(spark, sf, "part").select(n, _key(n).alias("stable_key"), F.col("p_name").alias("name"), F.concat(F.lit("u"), n.cast("string")).alias("url"), F.col("p_type").alias("sku"), (n % 10).alias("store_id"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("language"))
    ask = lambda asked, **by: search.admin_offers(own, over, **by).select(F.lit(asked).alias("asked"), "p_partkey", "n_manual")
    return ask("edited", text="RED", edited=True).unionByName(ask("unknown", language="unknown")).unionByName(ask("shop", store=3, language="Brand#7"))


# gates, terms, timetables

_MOMENT = "WITH m AS (SELECT event_id, ts AS now, ts - to_minutes(user_id * 17) AS run, CASE WHEN event_id % 5 <> 0 THEN ts - to_minutes(event_id % 120) END AS sent FROM events)"


@query(_MOMENT + """ SELECT event_id, extract(hour FROM timezone('America/Santiago', timezone('UTC', now))) BETWEEN 9 AND 22 AND epoch(now) - epoch(run) <= 86400 AND epoch(now) - epoch(run) > 1200 AND (sent IS NULL OR epoch(now) - epoch(sent) >= 3600) AS speak FROM m""")
def speaking_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's time is a moment to ask at."""
    at, back = F.col("ts").cast("timestamp"), lambda n: F.timestamp_add("MINUTE", F.negative(n), F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events")
    sent = F.when(F.col("event_id") % 5 != 0, back((F.col("event_id") % 120).cast("int")))
    return rows.select("event_id", changes.may_speak(at, back((F.col("user_id") * 17).cast("int")), sent).alias("speak"))


@query("SELECT p_partkey AS product_id FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00')")
def rested_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products that no event showed in the last three days."""
    shown = table(spark, sf, "events").select(F.col("user_id").alias("product_id"), F.col("ts").cast("timestamp").alias("shown_at"))
    return changes.cooled_down(products(spark, sf).select("product_id"), shown, _at("2024-01-08 00:00:00"), 3)


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS finished FROM orders) SELECT o_orderkey, CASE WHEN finished IS NULL OR finished + INTERVAL 36 HOUR <= TIMESTAMP '1996-01-01 12:00:00' THEN TIMESTAMP '1996-01-01 12:01:00' ELSE finished + INTERVAL 36 HOUR END AS due FROM r""")
def due_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Some never ran."""
    finished = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", changes.next_due(finished, _at("1996-01-01 12:00:00"), 36).alias("due"))


@query("SELECT p_partkey, (SELECT arg_min(o, (abs(o - p_size), o)) FROM (VALUES (6), (12), (24), (48)) t(o)) AS hours FROM part")
def nearest_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """X21."""
    return table(spark, sf, "part").select("p_partkey", changes.nearest(F.col("p_size"), [6, 12, 24, 48]).alias("hours"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1996-01-01' THEN o_orderdate ELSE TIMESTAMP '1996-01-01' END + to_days(CAST(o_orderkey % 60 AS INT)) AS ends FROM orders""")
def extended_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders are active members."""
    days = (F.col("o_orderkey") % 60).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", storage.extend_term(_at("1996-01-01 00:00:00"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus") == "O", days).alias("ends"))


# stored tables


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, TIMESTAMP '2024-01-01' AS f, TIMESTAMP '2024-01-01' AS l FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 END AS price FROM part WHERE p_partkey % 3 <> 1)
SELECT id, coalesce(n.name, s.name) AS name, coalesce(n.price, s.price) AS price, coalesce(f, TIMESTAMP '2024-02-01') AS first_seen_at, CASE WHEN n.name IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE l END AS last_seen_at FROM s FULL JOIN n USING (id)""")
def state_after_run(spark: SparkSession, sf: str) -> DataFrame:
    """Stored offers, seen ones, both; an unread price keeps the old one."""
    p, price = table(spark, sf, "part"), F.col("p_retailprice")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), price.alias("price"), _at("2024-01-01").alias("first_seen_at"), _at("2024-01-01").alias("last_seen_at"))
    seen = p.filter("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, price + 1).alias("price"))
    return changes.next_state(old, seen, ["id"], _at("2024-02-01"), ["price"])


@query("""WITH c AS (SELECT event_id, event_id % 3000 AS product_id, CASE event_id % 4 WHEN 0 THEN '  ' || props || chr(10) WHEN 1 THEN ' ' || chr(9) WHEN 2 THEN repeat('x', CAST(3990 + event_id % 20 AS INT)) END AS body FROM events)
SELECT event_id, product_id, md5(trim(body, ' ' || chr(9) || chr(10))) AS body_md5 FROM c WHERE length(trim(body, ' ' || chr(9) || chr(10))) BETWEEN 1 AND 4000 AND product_id IN (SELECT p_partkey FROM part)""")
def accepted_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Blank, missing and overlong comments, and those on products that do not exist, are refused."""
    n = F.col("event_id")
    body = _cases(n, F.concat(F.lit("  "), "props", F.lit("\n")), F.lit(" \t"), F.repeat(F.lit("x"), (3990 + n % 20).cast("int")), None)
    new = table(spark, sf, "events").select("event_id", (n % 3000).alias("product_id"), body.alias("body"), F.lit("  ").alias("author"))
    return changes.accepted_comments(new, products(spark, sf)).select("event_id", "product_id", F.md5("body").alias("body_md5"))


@query("""SELECT 'shops' AS part, count(*) AS n FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'offers', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
UNION ALL SELECT 'history', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def shops_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Shops in debt go, and with them what refers to them; the rows that are left of each table."""
    s, lines = stores(spark, sf), table(spark, sf, "lineitem")
    left = storage.delete_cascade(
        s.filter("balance < 0"), "store_id",
        {"shops": (s, "store_id"), "offers": (lines.select("l_partkey", "l_suppkey").distinct(), "l_suppkey"), "history": (lines.select("l_suppkey"), "l_suppkey"), "events": (table(spark, sf, "events").select("user_id"), "user_id")},
    )
    out = None
    for name, rows in left.items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT 'k' || p_partkey AS offer_key, CASE WHEN p_partkey % 2 = 0 THEN p_partkey - p_partkey % 4 ELSE p_size END AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 'EAN_MATCH' ELSE 'SINGLETON' END AS method FROM part""")
def reassigned(spark: SparkSession, sf: str) -> DataFrame:
    """K8: one decision an offer; a new grouping moves every second one."""
    p, n = table(spark, sf, "part"), F.col("p_partkey")
    old = p.select(_key(n).alias("offer_key"), F.col("p_size").cast("long").alias("product_id"), F.lit("SINGLETON").alias("method"))
    return storage.upsert(old, p.filter(n % 2 == 0).select(_key(n).alias("offer_key"), (n - n % 4).alias("product_id"), F.lit("EAN_MATCH").alias("method")), ["offer_key"])


# lists of the keepers

_ALERTS = "WITH a AS (SELECT o_orderkey AS alert_id, o_custkey AS product_id, o_orderstatus = 'O' AS active, o_orderdate AS created_at FROM orders), h AS (SELECT event_id AS hit_id, user_id AS alert_id, event_type = 'view' AS seen, ts AS created_at FROM events)"


@query(_ALERTS + " SELECT nth, alert_id, name, active FROM (SELECT row_number() OVER (ORDER BY active DESC, created_at DESC, alert_id DESC) AS nth, alert_id, p_name AS name, active FROM a LEFT JOIN part ON p_partkey = product_id) WHERE nth <= 50")
def alert_list(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: active alerts first, newest first, with their product's name; a list of fifty."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("product_id"), (F.col("o_orderstatus") == "O").alias("active"), "o_orderdate")
    order = [F.desc("active"), F.desc("o_orderdate"), F.desc("alert_id")]
    return _numbered(a.orderBy(*order).limit(50), order).join(products(spark, sf), "product_id", "left").select("nth", "alert_id", "name", "active")


def _numbered(few: DataFrame, order: list[Column]) -> DataFrame:
    """Places in a list that a limit has made short."""
    from pyspark.sql import Window as W

    return few.withColumn("nth", F.row_number().over(W.orderBy(*order)))


@query(_ALERTS + " SELECT hit_id, h.alert_id, p_name AS name, h.created_at FROM h JOIN a USING (alert_id) JOIN part ON p_partkey = product_id WHERE NOT seen ORDER BY h.created_at DESC, hit_id DESC LIMIT 50")
def pending_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: the newest hits that nobody saw, of alerts and products that exist."""
    h = table(spark, sf, "events").filter("event_type <> 'view'").select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("alert_id"), F.col("ts").alias("created_at"))
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("product_id"))
    joined = h.join(a, "alert_id").join(products(spark, sf).select("product_id", "name"), "product_id")
    return joined.orderBy(F.desc("created_at"), F.desc("hit_id")).limit(50).select("hit_id", "alert_id", "name", "created_at")


@query("""SELECT 'drop' AS part, event_id AS id, s_name AS store, p_name AS name FROM (SELECT * FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 10) LEFT JOIN supplier ON s_suppkey = user_id % 7 LEFT JOIN part ON p_partkey = user_id
UNION ALL SELECT 'run', o_orderkey, s_name, NULL FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8) LEFT JOIN supplier ON s_suppkey = o_custkey % 7""")
def dashboard_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: the ten newest price drops and the eight newest runs, with names where there are any."""
    shop, name = stores(spark, sf).select("store_id", "store"), products(spark, sf).select("product_id", "name")
    drops = table(spark, sf, "events").filter("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    drops = drops.select(F.lit("drop").alias("part"), F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("store_id"), F.col("user_id").alias("product_id"))
    runs = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(8)
    runs = runs.select(F.lit("run").alias("part"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("store_id"), F.lit(None).cast("long").alias("product_id"))
    return drops.unionByName(runs).join(shop, "store_id", "left").join(name, "product_id", "left").select("part", "id", "store", "name")


@query("""SELECT 'manual' AS part, o_orderkey AS id, o_orderdate AS created_at FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) UNION ALL SELECT 'excluded', o_orderkey, o_orderdate FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)""")
def keepers_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: the newest corrections and the newest excluded offers."""
    newest = lambda part, status: table(spark, sf, "orders").filter(F.col("o_orderstatus") == status).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.lit(part).alias("part"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return newest("manual", "F").unionByName(newest("excluded", "P"))


_EDITION = "SELECT p_partkey AS product_id, p_name AS name, p_type AS type, p_size AS units, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS language, CASE p_partkey % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS set_code FROM part"


@query(f"""WITH p AS ({_EDITION}), k AS (SELECT *, string_split(name, ' ') AS w FROM p), n AS (SELECT DISTINCT a.name, b.name AS found, a.w AS w, b.w AS v FROM k a JOIN k b USING (type, units)), t AS (SELECT name, found, x, v, unnest(v) AS y FROM (SELECT name, found, v, unnest(w) AS x FROM n)),
o AS (SELECT name, found, x, CASE WHEN x = y THEN 1 WHEN starts_with(y, x) OR starts_with(x, y) THEN 0.9 WHEN contains(y, x) THEN 0.75 WHEN jaro_winkler_similarity(x, y) > 0.88 THEN 0.7 * jaro_winkler_similarity(x, y) ELSE 0 END AS s FROM t),
s AS (SELECT name, found, avg(m) AS likeness FROM (SELECT name, found, x, max(s) AS m FROM o GROUP BY ALL) GROUP BY ALL), c AS (SELECT a.product_id, b.language AS edition, b.product_id AS other, round(likeness, 6) AS likeness, row_number() OVER (PARTITION BY a.product_id, b.language ORDER BY likeness DESC, b.product_id) AS nth
  FROM p a JOIN p b ON a.type = b.type AND a.units = b.units AND b.language IS NOT NULL AND b.language IS DISTINCT FROM a.language AND (a.set_code IS NULL OR b.set_code IS NULL OR a.set_code = b.set_code) JOIN s ON s.name = a.name AND s.found = b.name WHERE likeness >= 0.55)
SELECT product_id, edition, other, likeness FROM c WHERE nth = 1""")
def other_editions(spark: SparkSession, sf: str) -> DataFrame:
    """Editions (brands) of parts of one type and size, alike by name; an eleventh has no edition, a third no set."""
    n = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        n.alias("product_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("game"), F.col("p_type").alias("type"), F.col("p_size").alias("units"),
        F.when(n % 11 != 0, F.col("p_brand")).alias("language"), _cases(n, None, F.lit("x"), F.lit("y")).alias("set_code"),
    )
    return search.other_editions(p).withColumn("likeness", F.round("likeness", 6))
