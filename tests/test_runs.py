"""A shop's run case by case; matching again equals matching anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pricegrain.operators import ingest, rematch, resolve
from pricegrain.plans import matching

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def test_a_run_case_by_case(spark):
    seen_kind = "store_id long, offer_key string, name string, price double, stock_status string, content_hash string, brand string"
    kind = seen_kind + ", is_active boolean, first_seen_at timestamp, last_seen_at timestamp, last_changed_at timestamp, last_price_change_at timestamp, last_recorded_at timestamp"
    old = lambda s, k, price=5.0, stock="in_stock", digest="d", active=True, recorded=T(1): (s, k, f"name {k}", price, stock, digest, "B", active, T(1), T(1), T(1), T(1), recorded)
    stored = spark.createDataFrame([
        old(1, "same"), old(1, "drop"), old(1, "restock", stock="coming_soon"), old(1, "renamed"), old(1, "quiet", recorded=T(2, 12)), old(1, "due"), old(1, "gone"), old(1, "was gone", active=False), old(1, "back", active=False),
        old(1, "alive"), old(1, "no price"), old(2, "dead shop"), old(3, "confirmed"), old(1, "unread", price=None),
    ], kind)
    seen = spark.createDataFrame([
        (1, "same", "name same", 9.0, "out_of_stock", "d", None), (1, "drop", "name drop", 4.0, "in_stock", "e", None), (1, "restock", "name restock", 5.0, "in_stock", "e", "C"), (1, "renamed", "other", 5.0, "in_stock", "e", "B"),
        (1, "quiet", "name quiet", 5.0005, "in_stock", "e", "B"), (1, "due", "name due", 5.0, "in_stock", "e", "B"), (1, "back", "name back", 5.0, "in_stock", "d", "B"), (1, "fresh", "F", 1.0, "unknown", "x", None),
        (1, "no price", "name no price", None, "in_stock", "e", "B"), (1, "unread", "name unread", 2.0, "in_stock", "e", "B"),
    ], seen_kind)
    alive = spark.createDataFrame([(1, "alive"), (3, "confirmed"), (1, "never stored")], "store_id long, offer_key string")
    run = ingest.outcome(stored, seen, F.lit(T(3)), alive, keep_null=("brand",))
    got = {r.offer_key: r for r in run.collect()}
    assert {k: r.change for k, r in got.items()} == {
        "same": "unchanged", "drop": "changed", "restock": "changed", "renamed": "changed", "quiet": "changed", "due": "changed", "gone": "removed", "was gone": None, "back": "unchanged",
        "alive": "unchanged", "no price": "changed", "dead shop": None, "confirmed": "unchanged", "unread": "changed", "fresh": "new",
    }
    events = {k: [e.type for e in r.events] for k, r in got.items() if r.events}
    assert events == {"drop": ["price_drop"], "restock": ["back_in_stock"], "renamed": ["name_change"], "gone": ["removed_product"], "fresh": ["new_product"]}
    assert got["drop"].events[0].pct_change == -20.0
    assert {k for k, r in got.items() if r.price_recorded} == {"drop", "restock", "renamed", "due", "fresh", "unread"} and {k for k, r in got.items() if r.stock_recorded} == {"restock", "fresh"}
    assert {k for k, r in got.items() if not r.is_active} == {"gone", "was gone"} and got["drop"].brand == "B" and got["restock"].brand == "C"
    assert got["alive"].last_seen_at == T(3) and got["dead shop"].last_seen_at == T(1) and got["same"].price == 9.0 and got["same"].last_changed_at == T(1)
    assert ingest.counters(run).filter("store_id = 1").first().asDict() == {"store_id": 1, "found": 11, "new": 1, "updated": 7, "unchanged": 3, "removed": 1, "price_changes": 1, "stock_changes": 1}
    assert ingest.outcome(stored.limit(0), seen.limit(0), F.lit(T(3))).count() == 0


def test_matching_again_equals_matching_anew(spark, sf):
    now = matching.candidates(spark, sf)
    same, different = (matching._decisions(spark, sf, k) for k in ("same", "different"))
    old = now.withColumns({"set_code": F.when(F.col("id") % 50 != 7, F.col("set_code")), "language": F.when(F.col("id") % 50 != 7, F.col("language")).otherwise("fr")}).filter("id % 100 <> 57 OR id > 150")
    old = old.unionByName(old.filter("id = 11").withColumns({"id": F.lit(100_000).cast("long"), "stable_key": F.lit("gone")}))
    stats = resolve.token_stats(old)
    before = rematch.match(old, same, different.filter("a > 20"), stats)
    changed = now.filter("id % 50 = 7").select("id").unionByName(spark.createDataFrame([(100_000,)], "id long"))
    after, anew = rematch.rematch(before, now, changed, same, different, stats), rematch.match(now, same, different, stats)
    rows = lambda d: sorted(map(tuple, d.collect()))
    for part in ("scored", "assignment", "reviews"):
        assert rows(getattr(after, part)) == rows(getattr(anew, part))
    assert after.n_scored < anew.n_scored / 4 and after.n_grouped < anew.n_grouped
    again = rematch.rematch(after, now, changed.limit(0), same, different, stats)
    assert again.n_scored == 0 == again.n_grouped and rows(again.assignment) == rows(anew.assignment)
