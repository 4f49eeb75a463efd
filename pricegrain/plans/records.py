"""Records from raw offers, tables that are written and read again, runs with confirmed keys, merges by hand."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import text
from pricegrain.operators import changes, extract, resolve, storage
from pricegrain.plans.base import BASE, observations, spread, table
from pricegrain.plans.matching import _GROUPS, _SCORES, GOODS, _decisions, candidates
from pricegrain.plans.registry import ORACLE, query
from pricegrain.plans.tables import export
from pricegrain.sources.export import write_csv, write_json
from pricegrain.sources.tables import read_table

#: 'new' names a series, so it says nothing once the series is known.
RECORDS = replace(GOODS, series_tokens=("new",))


@query(r"""WITH t AS (SELECT p_partkey, p_size AS n, p_partkey % 4 AS k, string_split(p_name, ' ') AS w,
  CASE p_partkey % 4 WHEN 0 THEN 'lot of ' || p_size || ' ' || p_name WHEN 1 THEN p_name || ' ' || p_size || ' pieces' WHEN 2 THEN p_name || ' & gear x3' ELSE p_name END AS name FROM part),
g AS (SELECT *, CASE WHEN w[2] IN ('bolt', 'gear') THEN w[2] WHEN k = 2 THEN 'gear' END AS kind, list_filter(string_split(replace(name, ' &', ''), ' '), lambda x: x NOT IN ('red', 'blue', 'new', 'x3') AND NOT (x = 'gear' AND w[2] = 'bolt')) AS kept FROM t),
u AS (SELECT *, CASE w[1] WHEN 'small' THEN 'Red line Small' WHEN 'new' THEN 'Red line New' WHEN 'old' THEN 'Blue line Old' END AS edition, CASE WHEN k = 0 AND n <> 45 AND n <= 60 AND NOT (coalesce(kind = 'bolt', false) AND n = 12) THEN n ELSE 1 END AS times FROM g)
SELECT p_partkey, name, CASE WHEN edition IS NOT NULL AND kind IS NOT NULL THEN edition || CASE kind WHEN 'bolt' THEN ' Bolt' ELSE ' Gear' END || CASE WHEN times > 1 THEN ' x' || times ELSE '' END ELSE name END AS canonical,
  array_to_string(kept, ' ') AS tokens, array_to_string(list_sort(list_distinct(kept)), ' ') AS name_key, 'shop::' || CASE WHEN n % 3 = 0 THEN 'https://s.test/p/' || p_partkey ELSE 'e' || p_partkey END AS stable_key,
  array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 AND p_partkey > 0 THEN lpad(p_partkey::VARCHAR, 14, '0') END, CASE WHEN p_partkey % 7 = 0 THEN lpad((p_partkey + 1)::VARCHAR, 14, '0') END], lambda x: x IS NOT NULL), ',') AS gtins,
  'M' || p_partkey AS mpn_key, sha256(name || '|' || n * 100 || '|in_stock') AS content_hash FROM u""")
def prepared_records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw offers, as a shop lists them, to records."""
    k, n, key = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat_ws(" ", F.lit("lot of"), n, "p_name")).when(k == 1, F.concat_ws(" ", "p_name", n, F.lit("pieces"))).when(k == 2, F.concat("p_name", F.lit(" &amp; gear x3"))).otherwise(F.col("p_name"))
    raw = spread(table(spark, sf, "part")).select(
        "p_partkey", F.concat(F.lit("  "), name, F.lit(" ")).alias("name"), F.when(k != 1, F.lit("as new, no box")).alias("description"), F.lit("shop").alias("store_code"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.lit("e"), key)).alias("external_id"),
        F.concat(F.lit("https://s.test/p/"), key).alias("url"), F.when(F.col("p_partkey") % 5 == 0, F.lpad(key, 13, "0")).alias("gtin"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("EAN "), F.lpad(key, 14, "0"))).alias("ean"),
        F.when(F.col("p_partkey") % 7 == 0, F.lpad((F.col("p_partkey") + 1).cast("string"), 12, "0")).otherwise("123").alias("upc"), F.concat(F.lit("m-"), key).alias("mpn"), (F.col("p_size") * 100).alias("price"), F.lit("in_stock").alias("stock_status"),
    )
    r = extract.prepare_records(raw, RECORDS, text.NameRules())
    canonical = extract.canonical_name(F.col("attributes"), F.col("name"), RECORDS)
    return r.select("p_partkey", "name", canonical.alias("canonical"), F.array_join("tokens", " ").alias("tokens"), "name_key", "stable_key", F.array_join("gtins", ",").alias("gtins"), "mpn_key", "content_hash")


def _again(rows: DataFrame, kind: str) -> DataFrame:
    """rows, written as text and read with their schema; a row that does not fit it fails."""
    path = f"{storage.scratch(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    (write_csv if kind == "csv" else write_json)(rows, path, "gzip")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    options = {"sep": ";", "timestampFormat": "yyyy-MM-dd HH:mm:ss"} if kind == "csv" else {}
    return storage.temporary(read_table(rows.sparkSession, path, schema, kind, **options), path)


@query(ORACLE["export"])
def csv_written(spark: SparkSession, sf: str) -> DataFrame:
    """The export as a file for spreadsheets, read again."""
    return _again(export(spark, sf), "csv")


@query(ORACLE["export"])
def json_written(spark: SparkSession, sf: str) -> DataFrame:
    """The export as lines of JSON, read again."""
    return _again(export(spark, sf), "json")


@query(_SCORES)
def scores_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that are written once and read the second time, though the offers come in another order."""
    c, folder = candidates(spark, sf), f"{storage.scratch(spark)}/scores-{uuid.uuid4().hex}"
    resolve.cached_scores(c, folder)
    return storage.temporary(resolve.cached_scores(c.repartition("name"), folder), folder).select("a", "b", "score", "method")


@query(BASE + """, a AS (SELECT product_id, store_id, max(CASE WHEN seen_at < TIMESTAMP '1996-01-01' THEN price END) AS old, max(CASE WHEN seen_at >= TIMESTAMP '1995-01-01' AND store_id % 3 > 0 THEN price END) AS now FROM observation GROUP BY ALL),
b AS (SELECT *, now IS NULL AND old IS NOT NULL AND (product_id + store_id) % 4 = 0 AND store_id % 5 > 0 AS confirmed FROM a), s AS (SELECT store_id FROM b GROUP BY 1 HAVING count(now) > 0 OR bool_or(confirmed))
SELECT store_id, product_id AS offer_key, CASE WHEN confirmed THEN 'unchanged' WHEN old IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN old = now THEN 'unchanged' ELSE 'changed' END AS change FROM b JOIN s USING (store_id) WHERE old IS NOT NULL OR now IS NOT NULL""")
def confirmed_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Offers that a shop confirms without sending them stay. A third of the shops send nothing: those that confirm
    something lose the rest, those that don't are left alone."""
    o = observations(spark, sf)
    snap = lambda cond: o.filter(cond).groupBy("store_id", F.col("product_id").alias("offer_key")).agg(F.max("price").alias("content_hash"))
    stored, seen = snap("seen_at < TIMESTAMP '1996-01-01'"), snap("seen_at >= TIMESTAMP '1995-01-01' AND store_id % 3 > 0")
    alive = stored.filter("(offer_key + store_id) % 4 = 0 AND store_id % 5 > 0").select("store_id", "offer_key")
    return changes.snapshot_diff(stored, seen, alive=alive)


# the groups before, the pairs that may be merged, and the groups made again with the decisions after
_BEFORE = _GROUPS.replace("final AS (", "final AS MATERIALIZED (")
_AGAIN = re.sub(r"\b(same|diff|anchors|edges|place|ordered|facts|apart|steps|final|made|ends|how)\b", r"\1_2", _GROUPS[_GROUPS.index("anchors AS ("):])
_MERGED = _BEFORE + """,
product AS (SELECT product_key, max(set_code) AS s, max(product_type) AS t, max(language) AS l FROM final JOIN own USING (id) GROUP BY 1),
wanted AS (SELECT DISTINCT least(x.product_key, y.product_key) AS p, greatest(x.product_key, y.product_key) AS q FROM final x JOIN final y ON y.id = x.id + 1 WHERE x.id % 12 = 3 AND x.product_key <> y.product_key),
pair AS MATERIALIZED (SELECT p, q, NOT coalesce(a.s <> b.s, false) AND NOT coalesce(a.t <> b.t, false) AND NOT coalesce(a.l <> b.l, false) AS allowed FROM wanted JOIN product a ON a.product_key = p JOIN product b ON b.product_key = q),
same_2 AS (SELECT a, b FROM same WHERE (a, b) NOT IN (SELECT (a, b) FROM diff) UNION SELECT p, q FROM pair WHERE allowed),
diff_2 AS (SELECT a, b FROM diff JOIN final x ON x.id = a JOIN final y ON y.id = b WHERE (least(x.product_key, y.product_key), greatest(x.product_key, y.product_key)) NOT IN (SELECT (p, q) FROM pair WHERE allowed)),
""" + _AGAIN + """, now AS (SELECT f.product_key, min(g.product_key) AS lo, max(g.product_key) AS hi FROM final f JOIN final_2 g USING (id) GROUP BY 1)
SELECT p, q, allowed, x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo AS merged FROM pair JOIN now x ON x.product_key = p JOIN now y ON y.product_key = q"""


@query(_MERGED)
def merged_products(spark: SparkSession, sf: str) -> DataFrame:
    """The products of every twelfth part and of the one after it are to be one; some were decided to be different."""
    c = candidates(spark, sf)
    stats = resolve.token_stats(c)
    scored = resolve.written(resolve.score_pairs(c, resolve.candidate_pairs(c, stats=stats), stats=stats).filter("score >= 75"), "scored")
    same, different = _decisions(spark, sf, "same"), _decisions(spark, sf, "different")
    before = resolve.group(c, scored, same, different)[0]
    # one decision a pair: what keeps apart is the later one
    by_hand = same.join(different, ["a", "b"], "left_anti").withColumn("decision", F.lit("same")).unionByName(different.withColumn("decision", F.lit("different")))
    at = F.lit("1998-01-01").cast("timestamp")
    key = lambda s: F.concat(F.lit("part::"), F.col(s).cast("string"))
    decisions = by_hand.select(F.least(key("a"), key("b")).alias("a_key"), F.greatest(key("a"), key("b")).alias("b_key"), "decision", at.alias("decided_at"))
    owner = before.select("id", "product_key")
    beside = owner.filter("id % 12 = 3").select((F.col("id") + 1).alias("id"), F.col("product_key").alias("_own")).join(owner, "id").filter("_own <> product_key")
    wanted = beside.select(F.least("_own", "product_key").alias("p"), F.greatest("_own", "product_key").alias("q"))
    return resolve.merge_products(c, scored, decisions, before, wanted, at + F.expr("INTERVAL 1 DAY"))[2]
