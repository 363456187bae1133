"""Footers, buckets by symbol and plans of partitions: rows, plans and edges."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.sources import bucketed as bk
from panelweave.sources import footers as ft
from panelweave.sources import parquet as pq


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    data = [(str(i % 7), dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), None if i % 3 == 0 else i, f"t{i}") for i in range(60)]
    return spark.createDataFrame(data, "sym string, date date, v double, k int, name string")


def test_bounds_come_from_footers(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    rows.repartition(4).write.parquet(root)
    got = {r.field: tuple(r)[1:] for r in ft.column_bounds(spark, root, ["date", "v", "k", "name"]).collect()}
    assert got == {"date": (60, "2020-01-01", "2020-02-29", 0), "v": (60, "0.0", "59.0", 0), "k": (60, "1", "59", 20), "name": (60, "t0", "t9", 0)}
    assert "PushedAggregation: [COUNT(*)]" in _plan(ft.stored_row_count(spark, root))
    pushed = _plan(ft._bounds(ft.footer_scan(spark, root), ["date", "v"], []))
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date), COUNT(date), MIN(v)" in pushed
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the user's session keeps its settings


def test_bounds_without_ranges_in_footers(spark, tmp_path):
    root = str(tmp_path / "t")
    data = [(1.0, None, 5), (float("nan"), None, 6), (-3.0, None, None)]
    spark.createDataFrame(data, "v double, e int, k int").coalesce(1).write.parquet(root)
    got = {r.field: (r.n_rows, r.lo, r.hi, r.null_count) for r in ft.column_bounds(spark, root, ["v", "e", "k"]).collect()}
    assert got == {"v": (3, "-3.0", "NaN", 0), "e": (3, None, None, 3), "k": (3, "5", "6", 1)}


def test_bounds_of_empty_tables_and_odd_names(spark, rows, tmp_path):
    rows.limit(0).write.parquet(str(tmp_path / "empty"))
    assert [tuple(r) for r in ft.column_bounds(spark, str(tmp_path / "empty"), ["k"]).collect()] == [("k", 0, None, None, 0)]
    rows.withColumnRenamed("k", "a.b").write.partitionBy("sym").parquet(str(tmp_path / "odd"))
    got = {r.sym: (r.n_rows, r.lo) for r in ft.column_bounds(spark, str(tmp_path / "odd"), ["a.b"], by=["sym"]).collect()}
    assert got[1] == (9, "1") and sum(n for n, _ in got.values()) == 60
    with pytest.raises(ValueError, match="no such column"):
        ft.column_bounds(spark, str(tmp_path / "odd"), ["nothing"])


def test_bucketed_panel_needs_no_exchange(spark, rows, tmp_path):
    index = rows.select("sym", "date", "v").union(spark.createDataFrame([(None, None, -1.0)], "sym string, date date, v double"))
    holes = spark.createDataFrame([(None, None, "none")], "sym string, date date, name string")
    member = rows.where("k is not null").select("sym", "date", "name").union(holes)
    for name, df in (("layout_index", index), ("layout_member", member)):
        bk.write_bucketed(df, name, 3, path=str(tmp_path / name))
        assert len([p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet"]) <= 3
    panel = bk.bucketed_panel(spark, "layout_index", ["layout_member"]).withColumn("before", F.lag("v").over(Window.partitionBy("sym").orderBy("date")))
    plan = _plan(panel)
    assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
    want = index.join(member, ["sym", "date"], "left").withColumn("before", F.lag("v").over(Window.partitionBy("sym").orderBy("date")))
    key = lambda r: tuple(map(str, r))
    assert sorted(panel.collect(), key=key) == sorted(want.collect(), key=key)
    with pytest.raises(ValueError, match="columns of several tables"):
        bk.bucketed_panel(spark, "layout_index", ["layout_index"])
    assert bk.read_bucketed(spark, "layout_index").count() == 61


def test_partition_plan(spark, rows, tmp_path):
    plan = lambda **kw: pq.partition_plan(rows, ["sym", "date"], **kw).first()
    assert (plan().granularity, plan().partition_by) == ("flat", None)
    # 59 days: one bucket by year or month, 59 by day; 30 buckets wanted are 29 off both, so the coarser; 40 are nearer to 59
    assert plan(flat_below=1, per_bucket=2).granularity == "year"
    assert plan(flat_below=1, per_bucket=1.5).granularity == "day"
    assert plan(flat_below=1, per_bucket=1.5).partition_by == "date"
    rows.select("v", "sym", F.trunc("date", "MM").alias("date")).write.partitionBy("sym", "date").parquet(str(tmp_path / "index"))
    assert [tuple(r) for r in pq.hive_keys(spark, str(tmp_path / "index")).orderBy("position").collect()] == [(0, "sym"), (1, "date")]
    like = plan(like=str(tmp_path / "index"))
    assert (like.granularity, like.partition_by, like.min_date) == ("identity", "date", dt.date(2020, 1, 1))
    assert pq.partition_plan(rows.limit(0), ["date"], flat_below=0).first().granularity == "flat"
    assert pq.partition_plan(rows, ["sym"], flat_below=0).first().granularity == "flat"
