"""Panels derived from the base tables: one row per symbol and date, unique on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same panels as SQL, for checks against another engine.
FXS_SQL = """SELECT CAST(l_suppkey AS VARCHAR) AS sym, CAST(l_shipdate AS DATE) AS date, ROUND(AVG(l_discount), 8) - 0.05 AS r,
    CAST(MAX(s_nationkey) % 5 AS VARCHAR) AS ic, ROUND(SUM(l_extendedprice), 2) AS fv, SUM(l_quantity) AS x
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
FXE_SQL = """SELECT CAST(user_id AS VARCHAR) AS sym, CAST(ts AS DATE) AS date, ROUND((AVG(value) - 100) / 10000, 8) AS r,
    CAST(MAX(user_id) % 4 AS VARCHAR) AS ic, ROUND(SUM(value), 2) AS fv, ROUND(MAX(value), 6) AS x, COUNT(*) AS n
    FROM events GROUP BY 1, 2"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by ship date: return r, group ic, size fv, factor x."""
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    daily = items.groupBy(F.col("l_suppkey"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.round(F.avg("l_discount"), 8) - 0.05).alias("r"), F.round(F.sum("l_extendedprice"), 2).alias("fv"), F.sum("l_quantity").alias("x")
    )
    # the dimension is joined after the aggregation, to far fewer rows
    out = daily.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).cast("string").alias("ic")), "l_suppkey")
    return out.select(F.col("l_suppkey").cast("string").alias("sym"), "date", "r", "ic", "fv", "x")


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day of event: r, ic, fv, x and the number of events n."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("sym"), F.col("ts").cast("date").alias("date")).agg(
        F.round((F.avg("value") - 100) / 10000, 8).alias("r"), (F.max("user_id") % 4).cast("string").alias("ic"), F.round(F.sum("value"), 2).alias("fv"), F.round(F.max("value"), 6).alias("x"), F.count(F.lit(1)).alias("n")
    )
