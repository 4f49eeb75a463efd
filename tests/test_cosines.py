"""Cosines of all pairs of a key, from classes of rows with the same tokens."""

from __future__ import annotations

from pricegrain.operators import resolve


def test_all_pairs_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CELL", 2)
    rows = [(i, "k", ["a", "b"] if i % 2 else ["b", "a"]) for i in range(5)] + [(9, "k", ["c"]), (7, "k", None), (8, "k", []), (6, "l", ["a"]), (5, None, ["a"])]
    got = {(r.a, r.b): r.cosine for r in resolve.pair_cosines(spark.createDataFrame(rows, "id long, key string, tokens array<string>")).collect()}
    ids = [0, 1, 2, 3, 4, 7, 8, 9]
    assert got == {(a, b): float(b < 5) for a in ids for b in ids if a < b}


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TASK_PAIRS", 50)
    rows = [(i, f"k{i % 2}", ["a", str(i % 3)]) for i in range(120)]
    found = resolve.pair_cosines(spark.createDataFrame(rows, "id long, key string, tokens array<string>"))
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 2 * 60 * 59 // 2
    assert len(sizes) >= 2 * 60 * 59 / 2 / 50
