"""Merges by hand whose outcome is known, and the highlight's choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricegrain.operators import resolve
from pricegrain.plans import catalogue

OFFER = "id long, stable_key string, game string, set_code string, product_type string, language string, gtins array<string>"
DECISION = "a_key string, b_key string, decision string, decided_at int"


def merge(spark, offers, owners, decisions, wanted):
    c = spark.createDataFrame([(i, f"k{i}", None, s, None, None, []) for i, s in offers], OFFER)
    scored = spark.createDataFrame([], "a long, b long, score double, method string")
    frames = spark.createDataFrame(decisions, DECISION), spark.createDataFrame(owners, "id long, product_key long"), spark.createDataFrame(wanted, "p long, q long")
    decided, after, outcome = resolve.merge_products(c, scored, *frames, F.lit(2))
    return {tuple(r) for r in decided.collect()}, {r.id: r.product_key for r in after.collect()}, {tuple(r) for r in outcome.select("p", "q", "allowed", "merged").collect()}


def test_merge_products(spark):
    """One pair was decided to be different, one has a third offer between, one clashes, one is a product and itself."""
    offers = [(i, {5: "x", 6: "y"}.get(i)) for i in range(1, 10)]
    owners = [(i, 3 if i == 7 else i) for i in range(1, 10)]
    decisions = [("k1", "k2", "different", 1), ("k3", "k7", "same", 1), ("k4", "k7", "different", 1), ("k3", "k8", "different", 1), ("k1", "old", "different", 1), ("k5", "k6", "different", 1)]
    decided, after, outcome = merge(spark, offers, owners, decisions, [(1, 2), (3, 4), (4, 8), (6, 5), (9, 9), (1, 2)])
    assert outcome == {(1, 2, True, True), (3, 4, True, True), (4, 8, True, False), (6, 5, False, False)}
    assert decided == {("k1", "k2", "same", 2), ("k3", "k4", "same", 2), ("k4", "k8", "same", 2), ("k3", "k7", "same", 1), ("k3", "k8", "different", 1), ("k1", "old", "different", 1), ("k5", "k6", "different", 1)}
    assert after == {1: 1, 2: 1, 3: 3, 4: 3, 7: 3, 5: 5, 6: 6, 8: 8, 9: 9}


def test_merge_nothing(spark):
    decisions = [("k1", "k2", "different", 1), (None, "k1", "same", 1)]
    decided, after, outcome = merge(spark, [(1, None), (2, None)], [(1, 1), (2, 2)], decisions, [])
    assert decided == set(decisions) and after == {1: 1, 2: 2} and outcome == set()
    assert merge(spark, [], [], [], [(1, 2)]) == (set(), {}, set())


def test_random_highlight(spark, sf):
    """One of the six best opportunities."""
    best = catalogue.QUERIES["opportunities"](spark, sf).orderBy(F.desc("saving"), "product_id").limit(6)
    (shown,) = catalogue.QUERIES["random_highlight"](spark, sf).collect()
    assert shown.product_id in {r.product_id for r in best.collect()}
