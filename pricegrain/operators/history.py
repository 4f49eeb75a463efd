"""Price series: newest observation, running best price, lows, deals, change points."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.operators.chains import greedy_chain


def latest_by(rows: DataFrame, keys: list[str], order: list[Column | str], values: list[str]) -> DataFrame:
    """The row of each key that is largest by order (W10: last wins). A maximum, so a hot key is
    one row a task before the shuffle and no window over it is needed. The maximum of a struct is aggregated by sorting:
    each task sorts its rows by key, and spills if it must."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def price_lows(history: DataFrame, current: DataFrame, key: str = "product_id", price: str = "price", within: float = 0.02) -> DataFrame:
    """A10: products with two distinct prices or more whose current price is at most the lowest ever plus a share.

    history has (key, price), current has one row (key, current). drop_pct = (highest - current) / highest.
    """
    stats = history.filter(F.col(price).isNotNull()).groupBy(key).agg(F.min(price).alias("lowest"), F.max(price).alias("highest"), F.count_distinct(price).alias("n_prices"))
    found = stats.filter("n_prices >= 2").join(current, key).filter(F.col("current") <= F.col("lowest") * (1 + within))
    return found.withColumn("drop_pct", F.try_divide(F.col("highest") - F.col("current"), F.col("highest")) * 100)


def price_changes(
    observed: DataFrame, key: list[str], order: list[Column | str], price: str = "price", status: str = "stock_status", time: str = "seen_at", step: float = 0.001, name: str | None = None, digest: str | None = None
) -> DataFrame:
    """R2: typed events between consecutive observations of an offer, one row each.

    price_drop and price_rise from a difference above step on; back_in_stock only from out_of_stock or coming_soon to
    in_stock; out_of_stock on reaching it; any other change of status is a stock_change; with name, a name_change.
    pct_change is of the old price. digest: a column; observations whose digest is that of the one before say nothing.
    """
    w = W.partitionBy(*key).orderBy(*order)
    was = lambda c: F.lag(c).over(w)
    own = {"_old_price": was(price), "_old_status": was(status), "_nth": F.row_number().over(w)}
    if name is not None:
        own["_old_name"] = was(name)
    if digest is not None:
        own["_same"] = was(digest).eqNullSafe(F.col(digest))
    moved = observed.withColumns(own).filter("_nth > 1")
    if digest is not None:
        moved = moved.filter("NOT _same")
    p, old, s, before = F.col(price), F.col("_old_price"), F.col(status), F.col("_old_status")
    pct = F.round(F.try_divide(p - old, old) * 100, 4)
    event = lambda kind, a, b, change: F.struct(kind.alias("type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"), change.alias("pct_change"))
    none = F.lit(None).cast("double")
    found = [F.when(F.abs(p - old) > step, event(F.when(p < old, "price_drop").otherwise("price_rise"), old, p, pct))]
    kind = F.when((s == "in_stock") & before.isin("out_of_stock", "coming_soon"), "back_in_stock").when(s == "out_of_stock", "out_of_stock").otherwise("stock_change")
    found.append(F.when(s != before, event(kind, before, s, none)))
    if name is not None:
        found.append(F.when(~F.col(name).eqNullSafe(F.col("_old_name")), event(F.lit("name_change"), F.col("_old_name"), F.col(name), none)))
    events = F.filter(F.array(*found), lambda e: e.isNotNull())
    return moved.select(*key, F.col(time).alias("created_at"), "_nth", F.explode(events).alias("e")).select(*key, "created_at", F.col("_nth").alias("nth"), "e.*")


def daily_deals(events: DataFrame, since: Column, top: int, key: str = "product_id") -> DataFrame:
    """Largest drop of each product since a moment; event values are text and may not be numbers."""
    drop = F.expr("try_cast(old_value AS double) - try_cast(new_value AS double)")
    return events.filter((F.col("type") == "price_drop") & (F.col("created_at") >= since)).groupBy(key).agg(F.max(drop).alias("amount")).filter("amount > 0").orderBy(F.desc("amount"), key).limit(top)


def snapshots(observed: DataFrame, key: list[str], order: list[Column | str], price: str = "price", time: str = "seen_at", hours: float = 24, step: float = 0.001, digest: str | None = None) -> DataFrame:
    """Prices worth recording: an offer's first, each that differs from the one seen before by more than step, and else
    one as soon as so many hours have passed since the last recorded one. Null prices are not recorded. digest: a column;
    rows whose digest is that of the row before are not looked at."""
    w = W.partitionBy(*key).orderBy(*order)
    moved = F.abs(F.col(price) - F.lag(price).over(w)) > step
    rows = observed.withColumn("_moved", F.coalesce(moved, F.lit(False)))
    if digest is not None:
        same = (F.row_number().over(w) > 1) & F.lag(digest).over(w).eqNullSafe(F.col(digest))
        rows = rows.withColumn("_same", same).filter("NOT _same").drop("_same")
    return greedy_chain(rows.filter(F.col(price).isNotNull()), key, order, time, hours, "_moved").drop("_moved")


def running_best(observed: DataFrame, product: str = "product_id", store: str = "store_id", price: str = "price", time: str = "seen_at", segment: str = "year", whole: int = 100_000) -> DataFrame:
    """After each moment of a product, the lowest of the prices last seen in each store; a price holds until the store's next.

    Of several prices of a store at a moment the lowest counts. A task goes once through its sorted rows. The series of a product
    of more observations than `whole` is cut into segments of time (truncated dates); the prices that hold at a segment's start are
    carried in, one a store, so that it is the work of many tasks. Of other products nothing is carried.
    """
    spark, kind = observed.sparkSession, {f.name: f.dataType.simpleString() for f in observed.schema}
    numbered = kind[time] == "timestamp"  # as microseconds it costs Python far less
    seen = observed.filter(F.col(product).isNotNull() & F.col(price).isNotNull() & F.col(time).isNotNull())
    hot = F.broadcast(seen.groupBy(product).agg(F.count("*").alias("n")).filter(F.col("n") > whole).select(product, F.lit(True).alias("hot")))
    seg = F.when(F.col("hot"), F.unix_seconds(F.date_trunc(segment, time))).otherwise(0)
    points = lambda how: seen.join(hot, product, how).select(product, seg.alias("seg"), (F.unix_micros(time) if numbered else F.col(time)).alias("t"), store, F.col(price).alias("p"))

    cut = points("inner").groupBy(product, store, "seg", "t").agg(F.min("p").alias("p"))
    last = cut.groupBy(product, store, "seg").agg(F.max_by("p", "t").alias("p"), F.max("t").alias("t"))
    spans = last.withColumn("until", F.lead("seg").over(W.partitionBy(product, store).orderBy("seg")))
    segments = cut.select(product, F.col("seg").alias("into")).distinct()
    carried = spans.join(segments, product).filter((F.col("into") > F.col("seg")) & (F.col("until").isNull() | (F.col("into") <= F.col("until"))))
    both = points("left").withColumn("own", F.lit(1)).unionByName(carried.select(product, F.col("into").alias("seg"), "t", store, "p", F.lit(0).alias("own")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = both.repartition(n, product, "seg").sortWithinPartitions(product, "seg", "own", "t", F.desc("p"))  # a store's lowest comes last

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, moment, held, heap = None, None, {}, []

        def best() -> float:
            while held.get(heap[0][1]) != heap[0][0]:
                heapq.heappop(heap)
            return heap[0][0]

        for pdf in batches:
            out = []
            for prod, seg, t, shop, p, own in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if key is None or prod != key[0] or seg != key[1]:
                    if moment is not None:
                        out.append((key[0], moment, best()))
                    key, moment, held, heap = (prod, seg), None, {}, []
                elif moment is not None and t != moment:
                    out.append((prod, moment, best()))
                held[shop] = p
                heapq.heappush(heap, (p, shop))
                moment = t if own else None
            yield pd.DataFrame(out, columns=[product, time, "best_price"])
        if moment is not None:
            yield pd.DataFrame([(key[0], moment, best())], columns=[product, time, "best_price"])

    found = dealt.mapInPandas(sweep, f"{product} {kind[product]}, {time} {'long' if numbered else kind[time]}, best_price double")
    return found.withColumn(time, F.timestamp_micros(time)) if numbered else found


def held_until(observed: DataFrame, key: list[str], time: str = "seen_at") -> DataFrame:
    """Each observation with the end of its validity: the next one's time, null for the last."""
    return observed.withColumn("until", F.lead(time).over(W.partitionBy(*key).orderBy(time)))
