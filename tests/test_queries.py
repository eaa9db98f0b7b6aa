"""Every registered query against its SQL on the small tables, plus contract checks."""

import os

import pytest

import __spark_entry__ as entry
from quillfin.operators.running import HOT_ROWS_SETTING
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "segment_id", "score"]


ORDERED = ["topic_chunks", "numbered_pages", "unparsed_windows", "range_merge", "title_ranges", "lru_evict"]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_query_with_every_key_hot(spark, con, name):
    spark.conf.set(HOT_ROWS_SETTING, "0")
    try:
        assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
