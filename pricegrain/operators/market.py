"""Comparison of a product's offers: summaries, ranks, savings, facets, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offer_summary(offers: DataFrame, product: str = "product_id") -> DataFrame:
    """A1: counts, lowest prices with their stores, mean and last sighting of each product; offers without a price count as offers only.

    One pass; where prices tie, the smallest offer_id names the store.
    """
    cheapest = F.when(F.col("price").isNotNull(), F.struct("price", "offer_id", "store_id"))
    open_offer = F.when(F.col("available") & F.col("price").isNotNull(), F.struct("price", "offer_id", "store_id"))
    found = offers.groupBy(product).agg(
        F.count("*").alias("n_offers"), F.count_distinct("store_id").alias("n_stores"), F.count_if("available").alias("n_available"),
        F.min(cheapest).alias("_best"), F.min(open_offer).alias("_open"), F.max("price").alias("highest"), F.avg("price").alias("mean"), F.max("seen_at").alias("last_seen"),
    )
    return found.select(
        product, "n_offers", "n_stores", "n_available", F.col("_best.price").alias("best_price"), F.col("_best.store_id").alias("best_store"),
        F.col("_open.price").alias("best_available"), F.col("_open.store_id").alias("best_available_store"), "highest", "mean", "last_seen",
    )


def savings_amount(best: Column, other: Column) -> Column:
    return F.when(best.isNotNull() & (other > 0), other - best)


def savings_percent(best: Column, other: Column) -> Column:
    return F.when(best.isNotNull() & (other > 0), (other - best) / other * 100)


def offer_ranks(offers: DataFrame, product: str = "product_id") -> DataFrame:
    """Available offers first, then by price; unpriced ones have no rank and take none. The reference price is the
    lowest available one, else the lowest; is_best marks the offers that have it."""
    order = W.partitionBy(product).orderBy(F.col("price").isNull(), F.desc("available"), "price", "offer_id")
    every = W.partitionBy(product)
    ranked = offers.withColumns({
        "rank": F.when(F.col("price").isNotNull(), F.row_number().over(order)),
        "reference": F.coalesce(F.min(F.when(F.col("available"), F.col("price"))).over(every), F.min("price").over(every)),
    })
    return ranked.withColumns({
        "is_best": F.coalesce(F.col("price") == F.col("reference"), F.lit(False)),
        "over_amount": savings_amount(F.col("reference"), F.col("price")),
        "over_percent": savings_percent(F.col("reference"), F.col("price")),
    })


#: Order of opportunities to its columns; a product without a unit price comes last.
SAVINGS = {"amount": [("saving", False)], "percent": [("saving_percent", False)], "unit": [("best_unit_price", True)]}


def opportunities(offers: DataFrame, top: int | None = 24, listed: int = 6, product: str = "product_id", order: str = "amount") -> DataFrame:
    """What a product's best available price saves against the median, from two stores on. With its lowest prices. The first
    by order, a key of SAVINGS (an unknown one means amount); order 'unit' needs units and confidence, and adds the unit
    price of the best offer.

    Median and lowest prices are read from the ranked rows, which are sorted and may spill: nothing that is held in memory
    grows with a product's offers.
    """
    by_unit = order == "unit"
    entry = F.struct("price", "offer_id", "store_id", *(["units", "confidence"] if by_unit else []))
    w = W.partitionBy(product)
    i, n = F.col("_i"), F.col("_n")
    middle = (i == F.floor((n + 1) / 2)) | (i == F.floor(n / 2) + 1)
    found = (
        offers.filter(F.col("available") & F.col("price").isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy("price", "offer_id", "store_id")), "_n": F.count("*").over(w)})
        .groupBy(product)
        .agg(F.count_distinct("store_id").alias("n_stores"), F.avg(F.when(middle, F.col("price"))).alias("median_price"), F.min(entry).alias("_best"), F.sort_array(F.collect_list(F.when(i <= listed, entry))).alias("_all"))
        .filter("n_stores >= 2").withColumn("saving", F.col("median_price") - F.col("_best.price")).filter("saving > 0")
    )
    out = found.select(
        product, "n_stores", "median_price", F.col("_best.price").alias("best_price"), F.col("_best.store_id").alias("best_store"), "saving",
        (F.col("saving") / F.col("median_price") * 100).alias("saving_percent"), F.transform(F.slice("_all", 1, listed), lambda x: x["price"]).alias("lowest_prices"),
    )
    if by_unit:
        best = found.select(product, unit_price(F.col("_best.price"), F.col("_best.units"), F.col("_best.confidence")).alias("best_unit_price"))
        out = out.join(best, product)
    ranks = [F.asc_nulls_last(c) if up else F.desc(c) for c, up in SAVINGS.get(order, SAVINGS["amount"])]
    return out.orderBy(*ranks, product).limit(top) if top else out


def unit_price(price: str | Column = "price", units: str | Column = "units", confidence: str | Column = "confidence", least: float = 0.7) -> Column:
    """Price of a unit where the number of units is known well enough."""
    price, units, confidence = (F.col(c) if isinstance(c, str) else c for c in (price, units, confidence))
    return F.when((units > 0) & (confidence >= least), price / units)


def unit_price_ranking(offers: DataFrame, top: int, product: str = "product_id") -> DataFrame:
    """The best price of a unit of each product with more than one unit."""
    priced = offers.filter(F.col("available") & (F.col("units") > 1)).withColumn("unit_price", unit_price()).filter("unit_price IS NOT NULL")
    best = priced.groupBy(product).agg(F.min(F.struct("unit_price", "offer_id", "store_id", "price", "units")).alias("b"))
    return best.select(product, "b.unit_price", "b.store_id", "b.price", "b.units").orderBy("unit_price", product).limit(top)


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """A2: most frequent non-empty value of each group; of values alike, the one that comes first by order."""
    counted = rows.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct("_n", F.negative("_first"))).alias(value))


def master_attributes(rows: DataFrame, group: str, columns: list[str], order: str, units: str = "units", confidence: str = "confidence", least: float = 0.7) -> DataFrame:
    """A3: the majority of each column; of the units, among the confident rows first. One pass: columns are unpivoted, not joined."""
    sure = F.when(F.col(confidence) >= least, F.col(units).cast("string"))
    long = rows.select(group, F.col(order).alias("_o"), F.explode(F.map_from_entries(F.array(
        *(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns), F.struct(F.lit("_sure").alias("k"), sure.alias("v")), F.struct(F.lit("_any").alias("k"), F.col(units).cast("string").alias("v")),
    ))).alias("k", "v"))
    counted = long.filter("v IS NOT NULL AND v <> ''").groupBy(group, "k", "v").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
    best = counted.groupBy(group, "k").agg(F.max_by("v", F.struct("n", F.negative("first"))).alias("v"))
    wide = best.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return wide.select(group, *(F.col("m")[c].alias(c) for c in columns), F.coalesce(F.col("m")["_sure"], F.col("m")["_any"]).cast("int").alias(units))


def first_image(rows: DataFrame, group: str, image: str, order: str) -> DataFrame:
    """A4: the first image, by order, that a group's rows have; null where none has."""
    return rows.groupBy(group).agg(F.min_by(image, F.when(F.coalesce(F.col(image) != "", F.lit(False)), F.col(order))).alias(image))


def shortest_name(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """A4: the shortest name of each group; of names alike, the first by order."""
    return rows.filter(F.col(name) != "").groupBy(group).agg(F.min_by(name, F.struct(F.length(name), F.col(order))).alias(name))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A5: number of rows of each value of each column (null counts as 'unknown'): one scan and one aggregation, over a row for each column."""
    each = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns]
    named = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), e.alias("value")) for c, e in zip(columns, each)))).alias("f"))
    return named.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def category_rollup(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Counts (type, n) summed to the categories of members (category, position, type); empty ones go, the order is the given one."""
    return counts.join(F.broadcast(members), "type").groupBy("category", "position").agg(F.sum("n").alias("n")).filter("n > 0").orderBy("position")


def leave_one_out(offers: DataFrame, group: str = "product_id", price: str = "price", order: str = "offer_id", low: float = 0.45, high: float = 2.5, least: int = 3) -> DataFrame:
    """Each price against the median of the others of its group; ratios below low or above high are outliers.

    The median without a price follows from the sorted prices by position, so no group is collected into a row: with n
    prices and the i-th left out, the others' middle ones are read by number from the ranked rows around the middle.
    """
    priced = offers.filter(F.col(price).isNotNull())
    w = W.partitionBy(group)
    ranked = priced.withColumns({"_i": F.row_number().over(w.orderBy(price, order)), "_n": F.count("*").over(w)}).filter(F.col("_n") >= least)
    # without one price, the k-th of the others is the k-th or, from the one left out on, the next
    half = F.floor((F.col("_n") - 1) / 2)
    middle = ranked.filter((F.col("_i") >= half - 1) & (F.col("_i") <= half + 3))
    around = middle.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_i", price))).alias("_at"))
    kth = lambda k: F.try_element_at("_at", F.when(k < F.col("_i"), k).otherwise(k + 1).cast("int"))
    lower, upper = (F.floor(F.col("_n") / 2)).cast("int"), (F.floor((F.col("_n") - 1) / 2) + 1).cast("int")
    out = ranked.join(around, group).withColumn("others_median", (kth(lower) + kth(upper)) / 2)
    out = out.withColumn("ratio", F.try_divide(F.col(price), F.col("others_median")))
    return out.withColumn("outlier", (F.col("ratio") < low) | (F.col("ratio") > high)).drop("_i", "_n", "_at")


def market_position(offers: DataFrame, product: str = "product_id", slack: float = 1) -> DataFrame:
    """For available offers of products that have two or more of them: lowest price, number, and whether the price is at most slack above it."""
    open_ = offers.filter(F.col("available") & F.col("price").isNotNull())
    # summed before the shuffle and joined back, so that a product of very many offers may be split
    found = open_.groupBy(product).agg(F.min("price").alias("lowest"), F.count("*").alias("n_open")).filter("n_open >= 2")
    return open_.join(found, product).withColumn("cheapest", F.col("price") <= F.col("lowest") + slack)


def status_pivot(rows: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """Number of rows of each status; the values are given, so no pass is needed to find them."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def content_hash(*columns: str) -> Column:
    """Digest of a row's text; a null reads None."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)), 256)


def total_drop(runs: DataFrame, order: str, total: str, least: float = 0.25) -> DataFrame:
    """A24 over a run ledger: each run against the one before, flagged from a drop of the given share on."""
    w = W.orderBy(order)
    before = F.lag(total).over(w)
    return runs.withColumn("before", before).withColumn("drop_share", F.try_divide(F.col("before") - F.col(total), F.col("before"))).withColumn("alarm", F.coalesce(F.col("drop_share") >= least, F.lit(False)))


def inverse_document_frequency(rows: DataFrame, doc: str, tokens: str) -> tuple[DataFrame, int]:
    """(token, df, idf) and the number of documents: ln((N + 1) / (df + 1)) + 1."""
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1), n
