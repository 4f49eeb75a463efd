"""Corrections, decisions, gates and editions by worked values, nulls and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain.operators import changes, resolve, search, storage

_OVER = "entity_key string, attribute string, value string"


def test_overrides_are_taken_back_refused_and_put_over(spark):
    old = spark.createDataFrame([("k1", "language", "es"), ("k2", "set_code", "a")], _OVER)
    new = spark.createDataFrame([("k1", "language", None), ("k2", "language", ""), ("k3", "url", "ftp://x"), ("k3", "set_code", ""), ("k4", "price", "1")], _OVER)
    assert {tuple(r)[:2] for r in resolve.refused_overrides(new).collect()} == {("k3", "url"), ("k4", "price")}
    left = resolve.set_overrides(old, new)
    assert {tuple(r) for r in left.collect()} == {("k2", "set_code", "a"), ("k2", "language", ""), ("k3", "set_code", "")}
    rows = spark.createDataFrame([(k, "en", "b", "t", "u") for k in ("k1", "k2", "k3", None)], "stable_key string, language string, set_code string, product_type string, url string")
    got = {r.stable_key: (r.language, r.set_code, r.shown_url) for r in resolve.with_overrides(rows, left).collect()}
    assert got == {"k1": ("en", "b", "u"), "k2": (None, "a", "u"), "k3": ("en", "b", "u"), None: ("en", "b", "u")}
    assert resolve.with_overrides(rows.limit(0), left).count() == 0 == resolve.set_overrides(old.limit(0), new.limit(0)).count()


def test_decisions_in_either_order(spark):
    old = spark.createDataFrame([("a", "b", "same", 1)], "a_key string, b_key string, decision string, decided_at int")
    new = spark.createDataFrame([("b", "a", "different", 2), ("a", "b", "same", 3), ("d", "c", "different", 1)], old.schema)
    saved = resolve.save_decisions(old, new)
    assert {tuple(r) for r in saved.collect()} == {("a", "b", "same", 3), ("c", "d", "different", 1)}
    keys = spark.createDataFrame([(7, "a"), (5, "b")], "id long, stable_key string")
    assert {(r.a, r.b, r.a_missing, r.b_missing) for r in resolve.decision_sides(saved, keys).collect()} == {(7, 5, False, False), (None, None, True, True)}
    queue = spark.createDataFrame([(5, 7, "confirmed"), (5, 8, "rejected")], "a long, b long, status string")
    left, reviews = resolve.forget_decisions(saved, queue, keys, saved)
    assert left.count() == 0 and {tuple(r) for r in reviews.collect()} == {(5, 7, "pending"), (5, 8, "rejected")}


def test_gate(spark):
    rows = [("13:00", "12:00", None, True), ("13:00", "12:45", None, False), ("13:00", "12:00", "12:30", False), ("13:00", "12:00", "12:00", True), ("03:00", "02:00", None, False), ("13:00", None, None, False)]
    at = lambda c: F.to_timestamp(F.concat(F.lit("2024-01-05 "), F.col(c), F.lit(":00")))
    got = spark.createDataFrame(rows, "now string, run string, sent string, want boolean").select("want", changes.may_speak(at("now"), at("run"), at("sent")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_comments_and_cascade(spark):
    p = spark.createDataFrame([(1,)], "product_id long")
    new = spark.createDataFrame([(1, "\n hi\t", " "), (1, " \n", "x"), (2, "hi", "x"), (1, None, "x"), (1, "y" * 4001, "x"), (1, "y" * 4000, "me ")], "product_id long, body string, author string")
    assert {(len(r.body), r.author) for r in changes.accepted_comments(new, p).collect()} == {(2, None), (4000, "me")}
    left = storage.delete_cascade(p, "product_id", {"c": (new, "product_id"), "n": (spark.createDataFrame([(None,), (1,)], "ref long"), "ref")})
    assert left["c"].count() == 1 and [r.ref for r in left["n"].collect()] == [None]


def test_editions_and_admin_offers(spark):
    shape = "product_id long, name string, game string, type string, units int, language string, set_code string"
    rows = [
        (1, "red box", None, "box", None, "en", "s1"), (2, "red box", None, "box", 0, "es", None), (3, "red box", None, "box", 0, "es", "s1"), (4, "red box", None, "box", 0, "es", "s2"), (5, "blue tin", None, "box", 0, "es", "s1"),
        (6, "red box", "g", "box", 0, "es", "s1"), (7, "red box", None, None, 0, "es", "s1"), (8, "red box", None, "box", 0, None, "s1"), (9, "", None, "box", 0, "fr", "s1"),
    ]
    got = {tuple(r)[:3]: r.likeness for r in search.other_editions(spark.createDataFrame(rows, shape)).collect()}
    assert got == {(1, "es", 2): 1.0, (2, "en", 1): 1.0, (3, "en", 1): 1.0, (8, "en", 1): 1.0, (8, "es", 2): 1.0}
    assert search.other_editions(spark.createDataFrame([], shape)).count() == 0
    offers = spark.createDataFrame([(1, "k1", "Red", None, None, 1, None), (2, "k2", None, "u/RED", None, 2, "en"), (3, "k3", "blue", "u", "s", 1, "en")], "id long, stable_key string, name string, url string, sku string, store_id long, language string")
    over = spark.createDataFrame([("k2", "language", "x"), ("k2", "url", "y")], _OVER)
    ask = lambda **by: {(r.id, r.n_manual) for r in search.admin_offers(offers, over, **by).collect()}
    assert ask() == {(1, 0), (2, 2), (3, 0)} and ask(text="red") == {(1, 0), (2, 2)} and ask(edited=True) == {(2, 2)}
    assert ask(language="unknown") == {(1, 0)} and ask(store=1, language="en") == {(3, 0)}


def test_names_go_to_python_once_a_pair(spark):
    rows = spark.createDataFrame([(i, "red box", None, f"t{i % 9}", i % 5, "en", None) for i in range(90)], "product_id long, name string, game string, type string, units int, language string, set_code string")
    lines = search.other_editions(rows)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lines[next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x) + 1 :]
    assert "Aggregate" in next(x for x in below if "Aggregate" in x or "Join" in x)


def test_nearest_editions(spark):
    shape = "product_id long, name string, type string, brand string, size int"
    rows = [(1, "n", "t", "a", 10), (2, "n", "t", "b", 12), (3, "n", "t", "b", 8), (4, "n", "t", "c", 32), (5, "n", "t", "c", 33), (6, "n", "u", "b", 10), (7, "n", "t", None, 10), (8, "n", "t", "d", None), (9, None, "t", "a", 10)]
    rows += [(100 + i, "n", "t", "a", 10) for i in range(3000)]
    got = {tuple(r)[:3]: round(r.likeness, 6) for r in search.nearest_editions(spark.createDataFrame(rows, shape), ["name", "type"], "brand", "size", 50, 0.55).collect()}
    of = lambda i: {k[1:]: v for k, v in got.items() if k[0] == i}
    assert of(1) == of(100) == of(3099) == {("b", 2): 0.96, ("c", 4): 0.56} and of(4) == {("a", 1): 0.56, ("b", 2): 0.6} and of(5) == {("b", 2): 0.58}
    assert not (of(6) or of(7) or of(8) or of(9)) and of(3) == {("a", 1): 0.96}
