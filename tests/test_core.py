"""The flagship query, the reader and the registry."""
import duckdb
import pytest

import __spark_entry__ as entry_module
from brightwell.operators.pricing import PRICING_SUMMARY_SQL, pricing_summary
from brightwell.sources import read_table

SMALL = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_pricing_summary_agrees_with_sql(spark):
    duckdb.sql(f"create or replace view lineitem as select * from '{SMALL}/lineitem.parquet'")
    expected = duckdb.sql(PRICING_SUMMARY_SQL).df()
    found = pricing_summary(read_table(spark, SMALL, "lineitem")).toPandas()
    assert set(found.columns) == set(expected.columns)
    keys = ["l_returnflag", "l_linestatus"]
    found, expected = found.sort_values(keys), expected.sort_values(keys)
    assert found["n_items"].tolist() == expected["n_items"].tolist()
    assert found["sum_disc_price"].tolist() == pytest.approx(expected["sum_disc_price"].tolist(), abs=0.02)


def test_pricing_summary_of_nothing(spark):
    assert pricing_summary(read_table(spark, SMALL, "lineitem").where("false")).count() == 0


def test_pricing_summary_keeps_null_keys(spark):
    rows = spark.sql("select cast(null as string) l_returnflag, 'O' l_linestatus, 1D l_quantity, 2D l_extendedprice, 0D l_discount, timestamp_ntz'2020-01-01' l_shipdate")
    assert pricing_summary(rows.union(rows)).collect()[0]["n_items"] == 2


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = pricing_summary(read_table(spark, SMALL, "lineitem"))._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
