from __future__ import annotations

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from pricegrain.operators import changes, graph, history, market, resolve, search, storage
from pricegrain.schema import CANDIDATE
from pricegrain.sources import export, feeds, html, tables
from pricegrain.streaming import twins


def test_leave_one_out_small_groups(spark):
    rows = [(g, i, float(p)) for g, ps in enumerate([[1, 2, 9], [5, 5, 5, 5], [3, 1], [7, 1, 4, 4, 100]]) for i, p in enumerate(ps)]
    got = market.leave_one_out(spark.createDataFrame(rows, "product_id int, offer_id int, price double")).collect()
    by = {}
    for g, i, p in rows:
        by.setdefault(g, []).append((i, p))
    for r in got:
        others = sorted(p for i, p in by[r.product_id] if i != r.offer_id)
        n = len(others)
        assert r.others_median == (others[(n - 1) // 2] + others[n // 2]) / 2
    assert len(got) == 12


def test_running_best_is_a_running_map(spark):
    random.seed(1)
    t0 = dt.datetime(2020, 1, 1)
    rows = [(p, s, t0 + dt.timedelta(days=random.randint(0, 1500)), float(random.randint(1, 50))) for p in range(4) for s in range(5) for _ in range(30)]
    got = {(r.product_id, r.seen_at): r.best_price for r in history.running_best(spark.createDataFrame(rows, "product_id long, store_id long, seen_at timestamp, price double")).collect()}
    want = {}
    for p in range(4):
        held = {}
        for t, group in itertools.groupby(sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], -r[3])), key=lambda r: r[2]):
            for r in group:
                held[r[1]] = r[3]
            want[(p, t)] = min(held.values())
    assert got == want


def test_running_best_carries_into_segments_of_hot_products_only(spark):
    random.seed(2)
    t0 = dt.datetime(2020, 1, 1)
    rows = [(p, s, t0 + dt.timedelta(days=random.randint(0, 1500)), float(random.randint(1, 50))) for p in range(6) for s in range(5) for _ in range(20 if p % 2 else 3)]
    rows += [(7, 1, t0, 9.0), (7, 1, t0, 4.0), (7, 2, t0, 5.0), (7, 1, t0 + dt.timedelta(days=800), 8.0), (7, 3, None, 1.0), (7, 3, t0, None), (None, 1, t0, 1.0)]
    observed = spark.createDataFrame(rows, "product_id long, store_id long, seen_at timestamp, price double")
    by = lambda **k: sorted((r.product_id, r.seen_at, r.best_price) for r in history.running_best(observed, **k).collect())
    want = by(whole=0)
    assert [r for r in want if r[0] == 7] == [(7, t0, 4.0), (7, t0 + dt.timedelta(days=800), 5.0)]
    assert by(whole=50) == by() == by(whole=0, segment="month") == want
    swept = lambda **k: history.running_best(observed, **k)._jdf.queryExecution()
    assert "unix_micros" in swept().optimizedPlan().toString()
    naive = observed.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
    assert sorted((r.product_id, r.seen_at, r.best_price) for r in history.running_best(naive, whole=50).collect()) == want


def test_upsert_and_friends(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "n", 5.0)], "k int, v string, p double")
    new = spark.createDataFrame([(2, "B", 3.0), (3, None, None), (None, "N", None)], "k int, v string, p double")
    got = {r.k: (r.v, r.p) for r in storage.upsert(old, new, ["k"], keep_old=["v"], keep_null=["p"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 3.0), 3: (None, None), None: ("n", 5.0)}
    newest = storage.newest_wins(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, n int, v string"), ["k"], ["n"])
    assert {(r.k, r.v) for r in newest.collect()} == {(1, "y"), (2, "z")}
    counted = storage.counted_upsert(spark.createDataFrame([(1, 2)], "k int, c long"), spark.createDataFrame([(1, 1), (2, 1)], "k int, c long"), "k", "c")
    assert {tuple(r) for r in counted.collect()} == {(1, 3), (2, 1)}


def test_dead_shop_keeps_its_catalogue(spark):
    stored = spark.createDataFrame([(1, "a", "h"), (1, "b", "h"), (2, "c", "h"), (3, "d", "h")], "store_id int, offer_key string, content_hash string")
    seen = spark.createDataFrame([(1, "a", "x"), (1, "n", "h")], "store_id int, offer_key string, content_hash string")
    alive = spark.createDataFrame([(3, "d")], "store_id int, offer_key string")
    got = {(r.store_id, r.offer_key): r.change for r in changes.snapshot_diff(stored, seen, alive=alive).collect()}
    assert got == {(1, "a"): "changed", (1, "b"): "removed", (1, "n"): "new", (3, "d"): "unchanged"}


def test_search_options(spark):
    p = spark.createDataFrame([(1, "red box", "A", "t", None, 2, 1, 5.0, 6.0), (2, "blue", "B", "t", "en", 1, 0, None, None)], "product_id long, name string, brand string, type string, language string, n_stores int, n_available int, best_price double, best_available double")
    o = spark.createDataFrame([(1, 7, "x"), (2, 8, "scarlet red")], "product_id long, store_id long, name string")
    ids = lambda **k: sorted(r.product_id for r in search.search(p, o, **k).collect())
    assert ids() == [1, 2] and ids(brand="A") == [1] and ids(types=["t"]) == [1, 2] and ids(language="unknown") == [1] and ids(language="en") == [2]
    assert ids(in_stock=True) == [1] and ids(min_stores=1) == [1, 2] and ids(min_stores=2) == [1] and ids(low=1) == [1] and ids(high=5.5) == []
    assert ids(store=8) == [2] and ids(tokens=["RED"]) == [1, 2] and ids(tokens=["red", "box"]) == [1]


def candidate(i, **k):
    own = dict(id=i, stable_key=f"k{i}", game=None, set_code=None, product_type=None, language=None, units_total=None, quantity_confidence=0.0, name_key="", name="", tokens=[], gtins=[], mpns=[], sku=None) | k
    own["tokens"] = own["tokens"] or own["name"].split()
    own["name_key"] = own["name_key"] or " ".join(sorted(set(own["tokens"])))
    return tuple(own.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CANDIDATE)


def scores(spark, a, b, *more):
    c = frame(spark, candidate(1, **a), candidate(2, **b), *(candidate(10 + i, name=m) for i, m in enumerate(more)))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    r = resolve.score_pairs(c, pairs).first()
    return r.score, r.method


def test_pair_scores(spark):
    assert scores(spark, dict(name="x", gtins=["1"], game="a"), dict(name="y", gtins=["1"], game="b")) == (100.0, "EAN_MATCH")
    assert scores(spark, dict(name="x y", set_code="s"), dict(name="x y", set_code="t")) == (0.0, "FUZZY_MATCH")
    assert scores(spark, dict(name="x y", language="en"), dict(name="x y", language="es")) == (0.0, "FUZZY_MATCH")
    assert scores(spark, dict(name="x y"), dict(name="y x"))[1] == "NAME_MATCH"
    # the upper bound is cut before an equal name could raise the score
    q = dict(name="x y", set_code="s", product_type="t", quantity_confidence=0.9)
    assert scores(spark, q | dict(units_total=6), q | dict(units_total=36)) == (55.0, "FUZZY_MATCH")
    score, method = scores(spark, dict(name="a b c", mpns=["M"], set_code="s"), dict(name="z", mpns=["M"], set_code="s"))
    assert method == "SKU_MATCH" and score >= 95
    same = dict(set_code="s", product_type="t", units_total=6, quantity_confidence=0.9)
    score, method = scores(spark, dict(name="red mega box") | same, dict(name="red mega box extra") | same, *["extra word"] * 60)
    assert method == "ATTRIBUTE_MATCH" and 75 < score < 100


def test_groups_keep_constraints(spark):
    c = frame(spark, *(candidate(i, name=f"n{i}", language={3: "en", 4: "es"}.get(i), gtins=["g"] if i in (3, 4) else []) for i in range(1, 9)))
    scored = spark.createDataFrame([(1, 2, 95.0, "m", ""), (2, 3, 96.0, "m", ""), (2, 4, 95.5, "m", ""), (5, 6, 91.0, "m", ""), (6, 7, 80.0, "m", "")], "a long, b long, score double, method string, breakdown string")
    pair = "a long, b long"
    same, different = spark.createDataFrame([(5, 8)], pair), spark.createDataFrame([(6, 8)], pair)
    assignment, reviews, conflicts = resolve.group(c, scored, same, different)
    key = {r.id: r.product_key for r in assignment.collect()}
    assert key[1] == key[2] == key[3] != key[4]  # one group has one language, a shared code or not
    assert key[5] == key[8] != key[6]  # a human's separation beats a score
    assert {(r.a, r.b) for r in reviews.collect()} == {(2, 4), (5, 6), (6, 7)}
    assert conflicts.count() == 0 and len(key) == 8


def test_min_labels(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100)]
    got = {r.node: r.component for r in graph.min_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ids_are_kept(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, product_key long")
    old = spark.createDataFrame([(1, 70), (2, 70), (3, 70), (4, None)], "id long, product_id long")
    got = {r.product_key: r.product_id for r in resolve.keep_ids(a, old).collect()}
    assert got == {1: 70, 3: None, 4: None}


def test_review_queue(spark):
    q = spark.createDataFrame([(1, 2, "pending"), (3, 4, "rejected"), (5, 6, "pending"), (1, 9, "pending")], "a long, b long, status string")
    found = spark.createDataFrame([(1, 2), (3, 4), (7, 8)], "a long, b long")
    where = spark.createDataFrame([(i, i) for i in range(1, 9)], "id long, product_key long")
    got = {(r.a, r.b): r.status for r in resolve.sync_reviews(q, found, where, where).collect()}
    assert got == {(1, 2): "pending", (3, 4): "rejected", (7, 8): "pending"}
    closed = resolve.close_implied(q, spark.createDataFrame([(1, 7), (7, 2)], "a long, b long"))
    assert {(r.a, r.b): r.status for r in closed.collect()}[(1, 2)] == "confirmed"


PAGE = """<html><body><div class="card x"><h2 id="t">Box &amp; Co</h2><span class="price" data-v="9">$9.990</span></div><a href="/b">b</a>
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P1","sku":"s1","offers":[{"price":"5.990","availability":"http://schema.org/InStock"}],"brand":{"name":"Z"}},
{"@type":["Thing","Product"],"name":"P2","sku":"s2","image":["i.png"],"offers":{"lowPrice":7,"availability":"SoldOut"}}]}</script><script type="application/ld+json">{broken</script></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([("http://s/p", PAGE), ("http://s/q", None)], "url string, html string")
    got = {r.url: r for r in html.select_fields(pages, "html", {"name": "div.card h2", "price": "b.none, .price@data-v", "none": "i"}).drop("html").collect()}
    assert got["http://s/p"].name == "Box & Co" and got["http://s/p"].price == "9" and got["http://s/p"].none is None and got["http://s/q"].name is None
    offers = {r.url: r for r in html.ld_products(pages, "html").collect()}
    assert offers["http://s/p#s1"].price == 5990.0 and offers["http://s/p#s1"].brand == "Z" and offers["http://s/p#s1"].stock_status == "in_stock"
    assert offers["http://s/p#s2"].price == 7.0 and offers["http://s/p#s2"].image_url == "i.png" and offers["http://s/p#s2"].stock_status == "out_of_stock"


def test_bad_payloads(spark):
    pages = spark.createDataFrame([(1, "{oops"), (2, '{"items":[{"name":"a","url":"/a"}]}'), (3, None), (4, "[]")], "store_id int, payload string")
    assert feeds.bad_payloads(pages).count() == 1
    out = feeds.generic_offers(feeds.items(pages), "http://s").collect()
    assert [(r.store_id, r.url, r.price, r.stock_status) for r in out] == [(2, "http://s/a", None, "unknown")]


def test_sources_merge(spark):
    s = "url string, name string, price double, stock_status string"
    api, shop, page = spark.createDataFrame([("u", "A", None, "unknown")], s), spark.createDataFrame([("u", "B", 2.0, "unknown")], s), spark.createDataFrame([("u", "C", 3.0, "in_stock"), ("v", "D", 4.0, "unknown")], s)
    assert {tuple(r) for r in feeds.merged_sources(api, shop, page).collect()} == {("u", "A", 2.0, "in_stock"), ("v", "D", 4.0, "unknown")}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "á;b", 2.5), (2, None, None)], "id int, name string, price double")
    export.write_csv(rows.coalesce(1), f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("*.csv")).read_text("utf-8")
    assert text.startswith("﻿id;name;price") and '"á;b"' in text
    export.write_json(rows.coalesce(1), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_settings():
    assert tables.dotted({"a": {"b": 1, "c": 2}}, {"a.b": 5, "x.y": 1}) == {"a": {"b": 5, "c": 2}, "x": {"y": 1}}


def test_watch_stream_equals_batch(spark, sf):
    def states(e):
        t = F.col("event_type")
        return e.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(t == "error", 404).otherwise(200).alias("http_status"),
            F.when(t == "click", "in_stock").when(t == "view", "preorder").otherwise("out_of_stock").alias("stock_status"), F.col("value").alias("price"),
        )

    batch = changes.watch_events(states(spark.read.parquet(f"{sf}/events.parquet")), "url", ["ts", "event_id"]).select("url", "event_id", "event")
    stream = twins.finished(twins.watch(states(twins.events_stream(spark, sf))), "watch")
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in stream.collect()}


def test_ledger_sends_once(spark, sf, tmp_path):
    sent = []
    events = twins.events_stream(spark, sf).filter("event_type = 'error'").select("event_id")
    for i in range(2):
        twins.publish(events, f"file://{tmp_path}/ledger", "event_id", lambda df: sent.append(df.count()), tag=f"t{i}").start().awaitTermination()
    assert sent[0] > 0 and sum(sent[1:]) == 0


def test_terms(spark):
    m = spark.createDataFrame([("active", dt.datetime(2024, 1, 3, 12), None), ("active", dt.datetime(2024, 1, 3, 12), 3), ("active", dt.datetime(2023, 1, 1), None), ("baja", dt.datetime(2023, 1, 1), None)], "state string, expires_at timestamp, reminded int")
    got = changes.reminders(m, F.lit("2024-01-01").cast("timestamp"), [1, 3, 7])
    assert sorted((r.days_left, r.action) for r in got.collect()) == [(0, "expire"), (3, "remind")]
    r = spark.range(1).select(changes.nearest(F.lit(5), [1, 3, 6, 12]).alias("n"), storage.extend_term(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"), F.lit(True), F.lit(30)).alias("t")).first()
    assert r.n == 6 and r.t == dt.datetime(2024, 3, 2)
