"""One run of some shops against the stored offers: what changed, the events, what to record, the state afterwards, in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a stored offer has besides what is seen of it.
BOOKS = ("is_active", "first_seen_at", "last_seen_at", "last_changed_at", "last_price_change_at", "last_recorded_at")


def outcome(stored: DataFrame, seen: DataFrame, at: Column, alive: DataFrame | None = None, scope: str = "store_id", key: str = "offer_key", hours: float = 24, keep_null: tuple[str, ...] = (), step: float = 0.001) -> DataFrame:
    """X20 (R1-R5, K3, K4, K19): every stored or seen offer with change (new, changed, unchanged, removed, or null for one that the
    run does not concern), events, price_recorded, stock_recorded, and its columns after the run.

    stored and seen: scope, key, name, price, stock_status, content_hash and any others; stored has BOOKS too. seen has one
    row of a key; alive: keys confirmed without being read. Shops of which nothing was seen or confirmed are left alone,
    and so are offers that had gone before and were not seen. An offer that comes back is compared with what was stored.
    Only a changed digest makes events of price, stock and name. A price is recorded when new, when it moved by more than
    step, or else, if the digest changed, once so many hours have passed since the last record. keep_null: columns whose
    old value stays where the new one is null.
    """
    columns = [c for c in stored.columns if c not in (scope, key, *BOOKS)]
    had = stored.select(scope, key, F.struct(*columns, *BOOKS).alias("o"))
    now = seen.select(scope, key, F.struct(*columns).alias("n"))
    joined = had.join(now, [scope, key], "full")
    shops = seen.select(scope)
    if alive is not None:
        joined = joined.join(alive.select(scope, key).distinct().withColumn("_alive", F.lit(True)), [scope, key], "left")
        shops = shops.unionByName(alive.select(scope))
    else:
        joined = joined.withColumn("_alive", F.lit(None).cast("boolean"))
    joined = joined.join(shops.distinct().withColumn("_ran", F.lit(True)), scope, "left")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    is_new, is_seen = F.col("o").isNull(), F.col("n").isNotNull()
    changed = ~is_new & is_seen & ~o("content_hash").eqNullSafe(n("content_hash"))
    confirmed = ~is_seen & ~is_new & F.coalesce("_alive", F.lit(False))
    gone = ~is_seen & ~is_new & ~confirmed & F.coalesce(F.col("_ran"), F.lit(False)) & F.coalesce(o("is_active"), F.lit(False))
    change = F.when(is_new, "new").when(changed, "changed").when(is_seen | confirmed, "unchanged").when(gone, "removed")
    moved = changed & F.coalesce(F.abs(n("price") - o("price")) > step, F.lit(False))
    restocked = changed & ~o("stock_status").eqNullSafe(n("stock_status"))
    rested = o("last_recorded_at").isNull() | (F.unix_micros(at) - F.unix_micros(o("last_recorded_at")) >= int(hours * 3_600_000_000))
    recorded = n("price").isNotNull() & (is_new | moved | (changed & rested))

    def event(when: Column, kind: Column, old: Column, new: Column, pct: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.when(when, F.struct(kind.alias("type"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), (none if pct is None else pct).alias("pct_change")))

    nothing = F.lit(None).cast("string")
    stock_kind = F.when((n("stock_status") == "in_stock") & o("stock_status").isin("out_of_stock", "coming_soon"), "back_in_stock").when(n("stock_status") == "out_of_stock", "out_of_stock").otherwise("stock_change")
    events = F.array(
        event(is_new, F.lit("new_product"), nothing, n("name")),
        event(moved, F.when(n("price") < o("price"), "price_drop").otherwise("price_rise"), o("price"), n("price"), F.try_divide(n("price") - o("price"), o("price")) * 100),
        event(restocked, stock_kind, o("stock_status"), n("stock_status")), event(changed & ~o("name").eqNullSafe(n("name")), F.lit("name_change"), o("name"), n("name")),
        event(gone, F.lit("removed_product"), o("name"), nothing),
    )
    value = lambda c: F.when(is_seen, F.coalesce(n(c), o(c)) if c in keep_null else n(c)).otherwise(o(c))
    books = {
        "is_active": F.when(is_seen | confirmed, True).when(gone, False).otherwise(o("is_active")), "first_seen_at": F.when(is_new, at).otherwise(o("first_seen_at")),
        "last_seen_at": F.when(is_seen | confirmed, at).otherwise(o("last_seen_at")), "last_changed_at": F.when(is_new | changed | gone, at).otherwise(o("last_changed_at")),
        "last_price_change_at": F.when(is_new | moved, at).otherwise(o("last_price_change_at")), "last_recorded_at": F.when(recorded, at).otherwise(o("last_recorded_at")),
    }
    return joined.select(
        scope, key, change.alias("change"), F.filter(events, lambda e: e.isNotNull()).alias("events"), recorded.alias("price_recorded"), (is_new | restocked).alias("stock_recorded"),
        *(value(c).alias(c) for c in columns), *(v.alias(c) for c, v in books.items()),
    )


def state_after(run: DataFrame, columns: list[str]) -> DataFrame:
    """The stored offers after a run."""
    return run.select(*columns)


def events_of(run: DataFrame, scope: str = "store_id", key: str = "offer_key") -> DataFrame:
    """The run's events, one row each."""
    return run.select(scope, key, F.explode("events").alias("e")).select(scope, key, "e.*")


def counters(run: DataFrame, scope: str = "store_id") -> DataFrame:
    """Found, new, updated, unchanged, removed, price and stock changes of each shop that the run concerns."""
    is_ = lambda c: F.col("change") == c
    of = lambda *types: F.exists("events", lambda e: e["type"].isin(*types))
    return run.filter("change IS NOT NULL").groupBy(scope).agg(
        F.count_if(~is_("removed")).alias("found"), F.count_if(is_("new")).alias("new"), F.count_if(is_("changed")).alias("updated"), F.count_if(is_("unchanged")).alias("unchanged"), F.count_if(is_("removed")).alias("removed"),
        F.count_if(of("price_drop", "price_rise")).alias("price_changes"), F.count_if(of("back_in_stock", "out_of_stock", "stock_change")).alias("stock_changes"),
    )
