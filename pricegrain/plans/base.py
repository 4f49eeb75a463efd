"""The market that the driver's tables stand for: parts are products, suppliers are shops, order lines are price observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators.history import latest_by

NEWEST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
AVAILABLE = ("in_stock", "preorder")

_STOCK_SQL = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'in_stock' WHEN 'RO' THEN 'in_stock' WHEN 'AO' THEN 'preorder'
    WHEN 'NF' THEN 'out_of_stock' WHEN 'NO' THEN 'coming_soon' ELSE 'unknown' END"""
_CONFIDENCE_SQL = "CASE l_returnflag WHEN 'A' THEN 0.95 WHEN 'N' THEN 0.7 ELSE 0.5 END"

#: The same relations for the second engine: observation, offer (the newest observation of a product in a shop).
BASE = f"""WITH observation AS (
  SELECT l_partkey AS product_id, l_suppkey AS store_id, l_partkey * 1000000 + l_suppkey AS offer_id, l_extendedprice AS price, {_STOCK_SQL} AS stock_status,
    CAST(l_quantity AS INT) AS units, CAST({_CONFIDENCE_SQL} AS DOUBLE) AS confidence, CAST(l_shipdate AS TIMESTAMP) AS seen_at,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {", ".join(f"{c} DESC" for c in NEWEST)}) AS age, {", ".join(NEWEST[1:])}
  FROM lineitem
), offer AS (
  SELECT o.product_id, o.store_id, o.offer_id, o.price, o.stock_status, o.stock_status IN ('in_stock', 'preorder') AS available, o.units, o.confidence, o.seen_at,
    p.p_name AS name, p.p_brand AS brand, p.p_type AS type, p.p_size AS size
  FROM observation o JOIN part p ON p.p_partkey = o.product_id WHERE age = 1
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to tasks of a fixed number: a table of few row groups is read by as few tasks, and what is done with each of
    these rows costs far more than its way."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def stock_status() -> Column:
    code = F.concat("l_returnflag", "l_linestatus")
    return F.when(code.isin("AF", "RO"), "in_stock").when(code == "AO", "preorder").when(code == "NF", "out_of_stock").when(code == "NO", "coming_soon").otherwise("unknown")


def observations(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offer_id"),
        F.col("l_extendedprice").alias("price"), stock_status().alias("stock_status"), F.col("l_quantity").cast("int").alias("units"),
        F.when(F.col("l_returnflag") == "A", 0.95).when(F.col("l_returnflag") == "N", 0.7).otherwise(0.5).alias("confidence"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"), *extra,
    )


def available(status: str = "stock_status") -> Column:
    return F.col(status).isin(*AVAILABLE)


def bare_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest observation of each product in each shop: the order is total, so is the choice."""
    rows = observations(spark, sf_dir, *NEWEST).withColumn("available", available())
    order = [F.col(c) for c in NEWEST]
    return latest_by(rows, ["product_id", "store_id", "offer_id"], order, ["price", "stock_status", "available", "units", "confidence", "seen_at"])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_offers(spark, sf_dir).join(products(spark, sf_dir), "product_id")
