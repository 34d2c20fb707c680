"""Every registered query against its SQL over the smallest tables; the rest must run and give rows."""

import os

import pytest
from compare import differences

from quire.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, SF_DIR, name) == []


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_merges_and_tables_lie_on_the_same_two_hundred_sheets(spark):
    """A sheet's tables are its customers', so that every sheet that holds merges holds tables as well."""
    found = registry.QUERIES["merge_overlap_join"](spark, SF_DIR).select("sheet", "table_id")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    told = found.join(orders.withColumnRenamed("o_orderkey", "table_id"), "table_id")
    assert told.count() > 0 and told.filter("sheet <> o_custkey % 200").count() == 0
