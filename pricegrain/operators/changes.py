"""Snapshots against stored state, alerts, watch lists, ledgers, health, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricegrain.operators.chains import greedy_chain


def snapshot_diff(stored: DataFrame, seen: DataFrame, key: str = "offer_key", digest: str = "content_hash", scope: str = "store_id", alive: DataFrame | None = None) -> DataFrame:
    """(scope, key, change) with new, changed, unchanged or removed.

    stored holds active rows. A scope (shop) with nothing seen is left alone: a dead shop loses no offer. alive: keys that
    were confirmed without being read (304); they count as unchanged.
    """
    confirmed = stored.join(alive.select(scope, key).distinct(), [scope, key], "left_semi") if alive is not None else stored.limit(0)
    now = seen.select(scope, key, digest).unionByName(confirmed.join(seen.select(scope, key), [scope, key], "left_anti").select(scope, key, digest))
    joined = stored.select(scope, key, F.col(digest).alias("_old"), F.lit(1).alias("_was")).join(now.select(scope, key, F.col(digest).alias("_new"), F.lit(1).alias("_is")), [scope, key], "full")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return joined.withColumn("change", change).join(now.select(scope).distinct(), scope, "left_semi").select(scope, key, "change")


def next_state(stored: DataFrame, seen: DataFrame, keys: list[str], at: Column, keep_null: list[str]) -> DataFrame:
    """K3, K4, K19 in one join: the stored table after a run. Columns in keep_null keep their value where the new one is null."""
    from pricegrain.operators.storage import upsert

    return upsert(stored, seen.withColumns({"first_seen_at": at, "last_seen_at": at}), keys, keep_old=["first_seen_at"], keep_null=keep_null)


def alert_hits(observed: DataFrame, alerts: DataFrame, key: str, order: list[Column | str], price: str = "price") -> DataFrame:
    """Each alert fires when the price is at most its target and below every price it fired at before.

    As long as prices above the target do not fire, the lowest price fired at is the lowest so far, so a running minimum is
    the whole state.
    """
    w = W.partitionBy("alert_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    met = observed.join(alerts, key).filter(F.col(price) <= F.col("target_price"))
    before = F.least(F.min(price).over(w), F.col("last_triggered_price"))
    return met.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(price) < F.col("_before"))).drop("_before")


def watch_events(states: DataFrame, key: str, order: list[Column | str], slack: float = 1.0) -> DataFrame:
    """What changed of a watched page since it was last read: (published, purchasable, sold_out, price_up, price_down), in this order of weight.

    The first sight of a page and unreadable ones (no status, or 400 and above) say nothing; an unreadable state is still
    what the next one is compared with.
    """
    w = W.partitionBy(key).orderBy(*order)
    was = lambda c: F.lag(c).over(w)
    rows = states.withColumns({"_http": was("http_status"), "_stock": was("stock_status"), "_price": was("price"), "_nth": F.row_number().over(w)})
    can = lambda c: F.coalesce(F.col(c).isin("in_stock", "preorder"), F.lit(False))
    there = F.coalesce(F.col("_http").between(1, 399), F.lit(False))
    kind = (
        F.when(~there, "published").when(can("stock_status") & ~can("_stock"), "purchasable").when(~can("stock_status") & can("_stock"), "sold_out")
        .when(F.abs(F.col("price") - F.col("_price")) > slack, F.when(F.col("price") > F.col("_price"), "price_up").otherwise("price_down"))
    )
    out = rows.filter((F.col("_nth") > 1) & F.col("http_status").between(1, 399)).withColumn("event", kind).filter("event IS NOT NULL")
    return out.withColumn("price_before", F.when(F.col("event").startswith("price"), F.col("_price"))).drop("_http", "_stock", "_price", "_nth")


def to_publish(events: DataFrame, sent: DataFrame, since: Column, top: int, key: str = "event_id") -> DataFrame:
    """Unsent events of the last hours, oldest first, so many at once."""
    return events.filter(F.col("created_at") >= since).join(sent.select(key), key, "left_anti").orderBy("created_at", key).limit(top)


def pending_count(events: DataFrame, sent: DataFrame, since: Column, types: list[str], key: str = "event_id") -> DataFrame:
    """How many events of some types since a moment wait to be published (n)."""
    waiting = events.filter((F.col("created_at") >= since) & F.col("type").isin(types)).join(sent.select(key), key, "left_anti")
    return waiting.agg(F.count("*").alias("n"))


def watch_pass(read: DataFrame, known: DataFrame, told: DataFrame, slack: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """X11: (events, state) of one pass over a watch list. read: what each page (url) says now (http_status, stock_status, price);
    known: what it said last; told: events (url, event, price) that were sent already. An event that was sent of the same
    page at the same price is not sent again. The state takes over what was read, also of unreadable pages; pages that were
    not read keep what is known, so a pass that failed before its state was stored may be run again."""
    columns = ["url", "http_status", "stock_status", "price"]
    both = known.select(*columns, F.lit(0).alias("_nth")).unionByName(read.select(*columns, F.lit(1).alias("_nth")))
    found = watch_events(both, "url", ["_nth"], slack).select("url", "event", "price", "price_before")
    sent = told.select("url", "event", F.col("price").alias("_price")).distinct().withColumn("_sent", F.lit(True))
    new = found.join(sent, (found["url"] == sent["url"]) & (found["event"] == sent["event"]) & found["price"].eqNullSafe(sent["_price"]), "left_anti")
    state = read.select(columns).unionByName(known.join(read.select("url"), "url", "left_anti").select(columns))
    return new, state


def worth_telling(drops: DataFrame, position: DataFrame, least: float, least_pct: float, most_pct: float, key: str = "offer_id") -> DataFrame:
    """F16: drops of an amount and a share that are not absurd; restocks of the cheapest offer only."""
    amount = F.expr("try_cast(old_value AS double) - try_cast(new_value AS double)")
    joined = drops.join(position.filter("cheapest").select(key, F.lit(True).alias("_c")), key, "left")
    big = (F.col("type") == "price_drop") & (amount >= least) & F.abs("pct_change").between(least_pct, most_pct)
    back = (F.col("type") == "back_in_stock") & F.col("_c").isNotNull()
    return joined.filter(big | back).drop("_c")


def cooled_down(candidates: DataFrame, shown: DataFrame, now: Column, days: int, key: str = "product_id") -> DataFrame:
    """Candidates not shown in the last days."""
    recent = shown.filter(F.col("shown_at") > now - F.make_dt_interval(F.lit(days))).select(key)
    return candidates.join(recent, key, "left_anti")


def store_health(runs: DataFrame, min_errors: int = 4, min_drop: float = 0.25) -> DataFrame:
    """Each shop's newest run: no rows, many errors, or a catalogue smaller by a share than in the run before."""
    w = W.partitionBy("store_id").orderBy("run_id")
    back = W.partitionBy("store_id").orderBy(F.desc("run_id"))
    last = runs.withColumns({"_before": F.lag("found").over(w), "_nth": F.row_number().over(back)}).filter("_nth = 1")
    problems = F.array(F.when(F.col("found") == 0, "empty"), F.when(F.col("errors") >= min_errors, "errors"), F.when(F.try_divide(F.col("_before") - F.col("found"), F.col("_before")) >= min_drop, "shrunk"))
    return last.select("store_id", "run_id", "found", "errors", F.filter(problems, lambda p: p.isNotNull()).alias("problems"))


def reminders(members: DataFrame, now: Column, steps: list[int]) -> DataFrame:
    """The smallest step that the days left have come to, once each; 'expire' when the term is over."""
    from pricegrain.functions.money import days_until

    left = days_until(F.col("expires_at"), now)
    step = F.array_min(F.filter(F.array(*map(F.lit, sorted(steps))), lambda s: s >= F.col("days_left")))
    rows = members.filter("state = 'active'").withColumn("days_left", left).withColumn("step", step)
    due = F.when(F.col("expires_at") <= now, "expire").when(F.col("step").isNotNull() & ~F.col("step").eqNullSafe(F.col("reminded")), "remind")
    return rows.withColumn("action", due).filter("action IS NOT NULL")


def next_due(finished: Column, now: Column, hours: float, soon_minutes: int = 1) -> Column:
    """The next run is an interval after the last; an overdue one comes soon."""
    at = F.timestamp_seconds(F.unix_timestamp(finished) + F.lit(int(hours * 3600)))
    soon = F.timestamp_seconds(F.unix_timestamp(now) + F.lit(60 * soon_minutes))
    return F.when(finished.isNull() | (at <= now), soon).otherwise(at)


def nearest(value: Column, options: list[int]) -> Column:
    """The allowed value that is nearest; of two, the smaller."""
    return F.array_min(F.transform(F.array(*map(F.lit, options)), lambda o: F.struct(F.abs(o - value).alias("d"), o.alias("v"))))["v"]


def presale(events: DataFrame, stores: list[str], types: list[str], usual: list[str], today: Column, until: str | None = None, enabled: bool = True, store: str = "store") -> DataFrame:
    """while a presale lasts, events of its shops alone, and of these the wider types as well; else the usual types of
    every shop. It is off without shops and after its last day; a last day that is no date does not end it."""
    end = F.try_to_timestamp(F.lit(until), F.lit("yyyy-MM-dd")).cast("date")
    on = F.lit(bool(enabled and stores)) & F.coalesce(today <= end, F.lit(True))
    wide = F.col(store).isin(stores or [""]) & F.col("type").isin([*usual, *types])
    return events.filter(F.when(on, wide).otherwise(F.col("type").isin(usual)))


def unsent(events: DataFrame, sent: DataFrame, store: int | None, types: list[str], since: Column, key: str = "event_id", store_col: str = "store_id") -> DataFrame:
    """Q18: events of a shop (None: of all), of given types and age, that no message told of."""
    own = events if store is None else events.filter(F.col(store_col) == store)
    return own.filter(F.col("type").isin(types) & (F.col("created_at") >= since)).join(sent.select(key), key, "left_anti")


def mark_seen(hits: DataFrame, ids: DataFrame | None = None, key: str = "hit_id") -> DataFrame:
    """Hits with seen set for the given ids, or for all of them; those seen before stay so."""
    if ids is None:
        return hits.withColumn("seen", F.lit(True))
    given = ids.select(key).distinct().withColumn("_given", F.lit(True))
    return hits.join(given, key, "left").withColumn("seen", F.coalesce("_given", "seen", F.lit(False))).drop("_given").select(hits.columns)


def health_notices(states: DataFrame, order: list[Column | str], now: str = "checked_at", hours: float = 12, recovered: bool = False) -> DataFrame:
    """Which of a shop's checks are worth a notice: (store_id, problems, ..., signature). The signature is the problems in
    order. A check tells if its signature is another than at the check before, or the same and so many hours have passed
    since the last telling (0 or less: never again). No problem tells nothing, but ends the signature; with recovered, the
    first check without problems after one with tells so, with an empty signature. Order begins with now.
    """
    w = W.partitionBy("store_id").orderBy(*order)
    rows = states.withColumn("signature", F.coalesce(F.array_join(F.array_sort("problems"), ","), F.lit("")))
    before = F.coalesce(F.lag("signature").over(w), F.lit(""))
    rows = rows.withColumn("_other", before != F.col("signature")).filter("_other OR signature <> ''")
    found = greedy_chain(rows, ["store_id"], order, now, hours, "_other") if hours > 0 else rows.filter("_other")
    return (found if recovered else found.filter("signature <> ''")).drop("_other")


def may_speak(now: Column, last_run: Column, last_sent: Column, band: tuple[int, int] = (9, 22), stale_hours: float = 24, quiet_hours: float = 1, run_minutes: int = 20, zone: str = "America/Santiago") -> Column:
    """Whether a filler may go out: the local hour is in the band, the newest run is neither too old nor just
    begun, and the last message is some time ago (or there was none)."""
    from pricegrain.functions.money import hours_since, in_hours

    age, silence = hours_since(last_run, now), hours_since(last_sent, now)
    return in_hours(now, *band, zone) & F.coalesce((age <= stale_hours) & (age * 60 > run_minutes), F.lit(False)) & F.coalesce(silence >= quiet_hours, F.lit(True))


def accepted_comments(new: DataFrame, products: DataFrame, key: str = "product_id", longest: int = 4000) -> DataFrame:
    """Comments on known products whose text, without white space at its ends, has one to so many characters; an empty
    author is none."""
    strip = lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    rows = new.withColumns({"body": strip("body"), "author": F.nullif(strip("author"), F.lit(""))})
    return rows.filter(F.char_length("body").between(1, longest)).join(products.select(key), key, "left_semi").select(new.columns)
