"""A run of some shops from end to end: two overlapping periods of the order lines are what was stored and what is seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import ingest
from pricegrain.operators.history import latest_by
from pricegrain.plans.base import BASE, NEWEST, observations
from pricegrain.plans.registry import query

_AT = "1998-12-01 00:00:00"
_LAST = f"QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY seen_at DESC, {', '.join(f'{c} DESC' for c in NEWEST[1:])}) = 1"
_OUTCOME = BASE + f""", o AS (SELECT store_id, product_id AS offer_key, 'n' || units AS name, price, stock_status, seen_at, product_id % 7 <> 0 AS is_active, CASE WHEN product_id % 5 <> 0 THEN seen_at END AS recorded FROM observation WHERE seen_at < TIMESTAMP '1996-01-01' {_LAST}),
n AS (SELECT store_id, product_id AS offer_key, 'n' || units AS name, price, stock_status FROM observation WHERE seen_at >= TIMESTAMP '1995-01-01' AND store_id % 3 <> 0 {_LAST}),
j AS (SELECT store_id, offer_key, o.name AS oname, n.name AS nname, o.price AS oprice, n.price AS nprice, o.stock_status AS ostock, n.stock_status AS nstock, o.is_active, o.seen_at, recorded, o.name IS NULL AS is_new, n.name IS NOT NULL AS is_seen,
  n.name IS NOT NULL AND o.name IS NOT NULL AND (o.name <> n.name OR o.price <> n.price OR o.stock_status <> n.stock_status) AS changed FROM o FULL JOIN n USING (store_id, offer_key)),
r AS (SELECT *, NOT is_seen AND store_id IN (SELECT store_id FROM n) AND is_active AS gone, changed AND abs(nprice - oprice) > 0.001 AS moved, is_seen AND (is_new OR changed AND (abs(nprice - oprice) > 0.001 OR recorded IS NULL OR recorded <= TIMESTAMP '{_AT}' - INTERVAL 24 HOUR)) AS records FROM j)"""


def _run(spark: SparkSession, sf: str) -> DataFrame:
    """Shops of every third number did not run; every seventh offer had gone before; of every fifth no price was recorded."""
    rows = observations(spark, sf, *NEWEST).withColumns({"name": F.concat(F.lit("n"), "units"), "offer_key": F.col("product_id")})
    rows = rows.withColumn("content_hash", F.md5(F.concat_ws("|", "name", "price", "stock_status")))
    last = lambda cond: latest_by(rows.filter(cond), ["store_id", "offer_key"], [F.col(c) for c in NEWEST], ["name", "price", "stock_status", "content_hash", "seen_at"])
    stored = last("seen_at < TIMESTAMP '1996-01-01'").withColumns({
        "is_active": F.col("offer_key") % 7 != 0, "first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at"), "last_changed_at": F.col("seen_at"), "last_price_change_at": F.col("seen_at"),
        "last_recorded_at": F.when(F.col("offer_key") % 5 != 0, F.col("seen_at")),
    }).drop("seen_at")
    seen = last("seen_at >= TIMESTAMP '1995-01-01' AND store_id % 3 <> 0").drop("seen_at")
    return ingest.outcome(stored, seen, F.lit(_AT).cast("timestamp"))


@query(_OUTCOME + f""" SELECT store_id, offer_key, CASE WHEN is_seen THEN nname ELSE oname END AS name, CASE WHEN is_seen THEN nprice ELSE oprice END AS price, CASE WHEN is_seen THEN nstock ELSE ostock END AS stock_status, is_seen OR (is_active AND NOT gone) AS is_active,
  CASE WHEN is_new THEN TIMESTAMP '{_AT}' ELSE seen_at END AS first_seen_at, CASE WHEN is_seen THEN TIMESTAMP '{_AT}' ELSE seen_at END AS last_seen_at, CASE WHEN is_new OR changed OR gone THEN TIMESTAMP '{_AT}' ELSE seen_at END AS last_changed_at,
  CASE WHEN is_new OR moved THEN TIMESTAMP '{_AT}' ELSE seen_at END AS last_price_change_at, CASE WHEN records THEN TIMESTAMP '{_AT}' ELSE recorded END AS last_recorded_at FROM r""")
def shop_run_state(spark: SparkSession, sf: str) -> DataFrame:
    """The stored offers after the run."""
    return ingest.state_after(_run(spark, sf), ["store_id", "offer_key", "name", "price", "stock_status", *ingest.BOOKS])


@query(_OUTCOME + """ SELECT store_id, offer_key, 'new_product' AS type, NULL AS old_value, nname AS new_value FROM r WHERE is_new
UNION ALL SELECT store_id, offer_key, CASE WHEN nprice < oprice THEN 'price_drop' ELSE 'price_rise' END, CAST(oprice AS VARCHAR), CAST(nprice AS VARCHAR) FROM r WHERE moved
UNION ALL SELECT store_id, offer_key, CASE WHEN nstock = 'in_stock' AND ostock IN ('out_of_stock', 'coming_soon') THEN 'back_in_stock' WHEN nstock = 'out_of_stock' THEN 'out_of_stock' ELSE 'stock_change' END, ostock, nstock FROM r WHERE changed AND ostock <> nstock
UNION ALL SELECT store_id, offer_key, 'name_change', oname, nname FROM r WHERE changed AND oname <> nname UNION ALL SELECT store_id, offer_key, 'removed_product', oname, NULL FROM r WHERE gone""")
def shop_run_events(spark: SparkSession, sf: str) -> DataFrame:
    """The run's events of all kinds."""
    return ingest.events_of(_run(spark, sf)).select("store_id", "offer_key", "type", "old_value", "new_value")


@query(_OUTCOME + """ SELECT store_id, count(*) FILTER (is_seen) AS found, count(*) FILTER (is_new) AS new, count(*) FILTER (changed) AS updated, count(*) FILTER (is_seen AND NOT is_new AND NOT changed) AS unchanged, count(*) FILTER (gone) AS removed,
  count(*) FILTER (moved) AS price_changes, count(*) FILTER (changed AND ostock <> nstock) AS stock_changes FROM r WHERE is_seen OR gone GROUP BY 1""")
def shop_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """X20, A21."""
    return ingest.counters(_run(spark, sf))
