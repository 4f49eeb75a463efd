"""Queries whose work on a row is large deal the rows of a small file to all tasks; scratch files are packed."""

import os

import pytest

from pricegrain.operators import resolve
from pricegrain.plans import catalogue
from pricegrain.sources import export


@pytest.mark.parametrize("name", ["normalize_name", "prepared_records", "page_products", "listing_cards"])
def test_rows_are_dealt(name, spark, sf):
    assert "Repartition" in catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("write", [export.write_csv, export.write_json])
def test_text_files_may_be_packed(write, spark, tmp_path):
    write(spark.range(3), f"{tmp_path}/x", "gzip")
    assert any(f.endswith(".gz") for f in os.listdir(f"{tmp_path}/x"))


def test_offers_of_a_code_meet_unsorted_and_their_pairs_in_many_tasks(spark):
    offers = [(1, ["x", "y"]), (2, ["x", "y"]), (3, ["y", "w"]), (4, ["z"]), (5, None), (6, [None, "x"]), (7, [None]), (8, ["w"])]
    found = resolve.gtin_edges(spark.createDataFrame(offers, "id long, gtins array<string>"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert sorted((r.a, r.b) for r in found.collect()) == [(1, 2), (1, 3), (1, 6), (3, 8)]
