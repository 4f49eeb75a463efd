"""Each query against its SQL in a second engine; those without SQL have rows, and other tests for their values."""

import pytest

from pricegrain.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(name, spark, sf):
    same(catalogue.QUERIES[name], catalogue.ORACLE[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_runs(name, spark, sf):
    # test_service holds the reviews against a plain greedy; the smallest tables leave none
    assert catalogue.QUERIES[name](spark, sf).count() > 0 or name == "review_queue"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
