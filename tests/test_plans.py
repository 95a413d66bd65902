"""Physical plans of the catalogue: no products, nested loops or Python, pruned scans."""

import re

import pytest

from keytable import queries as catalogue

LOOKUPS = {"count_rows"}  # one global aggregate each
EXACT = {"polygon_intersects", "geometry_join"}  # exact intersection is Python


@pytest.fixture
def no_broadcast(spark):
    """As for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan(spark, small, no_broadcast, name):
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop|BatchEvalPython", plan)
    assert name in EXACT or "ArrowEvalPython" not in plan
    assert name in LOOKUPS or "SinglePartition" not in plan


def test_a_hot_key_is_combined_before_the_shuffle(spark, small):
    plan = catalogue.QUERIES["last_write_wins"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    plan = catalogue.QUERIES["index_last_write"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_covering_lookup_reads_the_index_alone(spark, small):
    plan = catalogue.QUERIES["index_covering"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "Join" in catalogue.QUERIES["index_narrow"](spark, small)._jdf.queryExecution().executedPlan().toString()
