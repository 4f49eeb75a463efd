"""The index of names finds what a scan finds, and Python sees few tokens."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricegrain.functions import similarity
from pricegrain.operators import index


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(7)
    syllables = ["ba", "bra", "ss", "sma", "ll", "ti", "n", "cop", "per", "ox", "é", "日本", "a", "ab", "abc"]
    words = sorted({"".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(1500)})
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(3000)] + [(3001, ""), (3002, None), (3003, "small brass small")]
    return spark.createDataFrame(rows, "product_id long, name string")


@pytest.mark.parametrize("wanted", [["smal", "brass"], ["a"], ["coppre"], ["bass", "bass", "tin"], ["日本"], ["zzz"], [], ["abcabcabc", "é"], ["xoba"]])
def test_index_finds_what_the_scan_finds(spark, names, tmp_path_factory, wanted):
    tokens = F.split("name", " ")
    built = index.build(names, "product_id", tokens, f"{tmp_path_factory.mktemp('index')}/i")
    scan = names.select("product_id", similarity.search_score(F.array(*map(F.lit, wanted)).cast("array<string>"), F.filter(tokens, lambda t: t != "")).alias("score"))
    for least in (0.2, 0.45):
        want = sorted((r.product_id, round(r.score, 9)) for r in scan.filter(F.col("score") >= least).collect())
        assert sorted((r.product_id, round(r.score, 9)) for r in index.find(built, wanted, least).collect()) == want
    if wanted == ["smal", "brass"]:
        seen, vocabulary = index.matching_tokens(built, wanted).count(), built.vocabulary.count()
        assert vocabulary > 500 and seen < vocabulary / 2
        best = index.find(built, wanted, top=3).collect()
        assert [r.score for r in best] == sorted((r.score for r in best), reverse=True)


def test_every_pair_that_answers_is_a_candidate(spark, tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(700)})
    built = index.build(spark.createDataFrame(enumerate(words), "product_id long, name string"), "product_id", F.array("name"), f"{tmp_path}/i")
    asked = words[::35] + ["abcd", "acbd", "badc"]
    got = {(r.q, r.token) for r in index.matching_tokens(built, asked).collect()}
    want = {(q, t) for q in asked for t in words if similarity.token_likeness(q, t) > 0}
    assert want <= got
