"""Plan shapes that have to hold at scale."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_two_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    # Nested loops only attach a one-row aggregate.
    for part in text.split("BroadcastNestedLoopJoin")[1:]:
        assert "HashAggregate(keys=[]" in part


@pytest.mark.parametrize("name", ["maxsim_topk", "text_search_topk", "directory_listing"])
def test_rankings_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name) and "Partial" in plan(spark, name)


def test_scans_read_only_what_they_use(spark):
    text = plan(spark, "page_runs")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_scoring_does_not_shuffle_vectors(spark):
    text = plan(spark, "text_search_topk")
    above = text.split("MapInArrow")[0]
    assert above.count("Exchange") == 1 and "vectors" not in above


def test_recent_is_a_bounded_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "recent_queries")
