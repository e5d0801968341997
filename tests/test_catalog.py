import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    good, message = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert good, message


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "n"]


def test_filters_and_columns_reach_the_scan(spark):
    # Plan texts shorten scan details by default, which would hide the second date filter.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = entry.queries()["rel_02_pages_filter"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "o_orderpriority" in plan and "o_totalprice" not in plan
        dates = entry.queries()["src_15_table_slice"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in dates and "LessThanOrEqual(o_orderdate" in dates
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
