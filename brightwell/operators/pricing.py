"""Pricing summary over line items: the flagship smoke query."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pricing_summary(lineitem: DataFrame) -> DataFrame:
    """Counts, sums and extremes by return flag and line status.

    One shuffle of at most (flags x statuses) partial rows a task: Spark aggregates before it
    exchanges. Nulls in a key form their own group; an empty table gives no rows. Sums of doubles
    are rounded to cents, as their order isn't fixed.
    """
    price = F.col("l_extendedprice")
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_items"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("sum_price"),
        F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )


PRICING_SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS n_items, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""
