import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import cross_section as cs
from panelweave.functions import time_series as ts
from panelweave import catalog
from panelweave.operators import graph as gr
from panelweave.operators import incremental as inc
from panelweave.operators import panel as pn
from panelweave.operators import predicates as pr
from panelweave.operators import profile as pf
from panelweave.plans import chain, regress, testers
from panelweave.sources import parquet as pq

D = [dt.date(2024, 1, k) for k in range(1, 11)]


def test_bucket_handles_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", D[0], 1.0), ("b", D[0], 1.0), ("c", D[0], 3.0), ("d", D[0], None), ("e", D[0], 9.0)], "sym string, date date, x double")
    got = {r.sym: (r.k, r.b) for r in df.select("sym", cs.rank_avg("x").alias("k"), cs.bucket("x", 2).alias("b")).collect()}
    assert got == {"a": (1.5, 1), "b": (1.5, 1), "c": (3.0, 2), "d": (None, None), "e": (4.0, 2)}


def test_rolling_needs_full_window(spark):
    df = spark.createDataFrame([("a", d, v) for d, v in zip(D, [1.0, 2.0, None, 4.0, 5.0, 6.0])], "sym string, date date, x double")
    got = [r.v for r in df.select("date", ts.ts_sum("x", 3).alias("v")).orderBy("date").collect()]
    assert got == [None, None, None, None, None, 15.0]


def test_ema_equals_pandas(spark):
    pd = pytest.importorskip("pandas")
    x = np.random.default_rng(1).normal(size=10)
    df = spark.createDataFrame([("a", d, float(v)) for d, v in zip(D, x)], "sym string, date date, x double")
    got = [r.v for r in df.select("date", ts.ts_ema("x", 4).alias("v")).orderBy("date").collect()]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=4).mean())


def test_asof_takes_last_known_row(spark):
    left = spark.createDataFrame([("a", D[2], 1.0), ("a", D[5], 2.0), ("b", D[0], 3.0)], "sym string, date date, p double")
    right = spark.createDataFrame([("a", D[1], 10.0), ("a", D[5], 20.0), ("b", D[1], 30.0)], "sym string, date date, x double")
    got = {(r.sym, r.date): r.x for r in pn.asof_panel(left, right).collect()}
    assert got == {("a", D[2]): 10.0, ("a", D[5]): 20.0, ("b", D[0]): None}


def test_panel_rejects_shared_names(spark):
    df = spark.createDataFrame([("a", D[0], 1.0)], "sym string, date date, x double")
    other = df.withColumnRenamed("x", "y")
    with pytest.raises(ValueError, match="also in"):
        pn.panel(df, {"m": (other, "left"), "n": (other, "left")})


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 40))
    y = 0.5 * x - z + rng.normal(size=40)
    df = spark.createDataFrame([(D[0], *map(float, r)) for r in zip(y, x, z)], "date date, y double, x double, z double")
    got = regress.cross_section_models(df, "y", {"m": ["x", "z"]}).first()
    a = np.stack([np.ones(40), x, z], axis=1)
    beta, rest, *_ = np.linalg.lstsq(a, y, rcond=None)
    error = np.sqrt(rest[0] / 37 * np.linalg.inv(a.T @ a)[1, 1])
    assert got.t_m == pytest.approx(beta[1] / error) and got.r2_m == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum())


def test_overlapping_equals_loop(spark):
    r = np.random.default_rng(3).normal(0, 0.1, size=10)
    df = spark.createDataFrame([(d, float(v)) for d, v in zip(D, r)], "date date, v double")
    got = [x.cum for x in testers.overlapping_cumulative(df, "v", 3).orderBy("date").collect()]
    value, want = {}, []
    for i, v in enumerate(r):
        value[i % 3] = value.get(i % 3, 1) * (1 + v)
        want.append(np.mean(list(value.values())) - 1)
    np.testing.assert_allclose(got, want)


def test_refresh_removes_emptied_bucket(spark, tmp_path):
    rows = [("a", dt.date(2023, 5, 1), 1.0), ("a", dt.date(2024, 5, 1), 2.0)]
    df = spark.createDataFrame(rows, "sym string, date date, x double")
    root = str(tmp_path / "t")
    pq.write_all(df, root)
    inc.refresh_buckets(spark, root, df.limit(0), dt.date(2023, 1, 1), dt.date(2023, 12, 31), None)
    assert [tuple(r) for r in pq.scan(spark, root).select("sym", "date", "x").collect()] == [rows[1]]
    assert not (tmp_path / "t" / "part=2023").exists()


def test_merge_events_null_means_everything(spark):
    ev = spark.createDataFrame([("upsert", ["a"], ["1"], ["d1"]), ("upsert", None, None, ["d2"])], "action string, field_scope array<string>, symbol_scope array<string>, datetime_scope array<string>")
    r = inc.merge_events(ev).first()
    assert r.symbol_scope is None and r.datetime_scope == ["d1", "d2"] and r.field_scope == ["a"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert {r.id: r.component for r in gr.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r.id: r.level for r in gr.topological_levels(edges).collect()} == {"a": 0, "d": 0, "b": 1, "e": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        gr.topological_levels(edges.union(spark.createDataFrame([("c", "a")], "src string, dst string")))


def test_chain_and_formulas(spark):
    df = spark.createDataFrame([("a", D[0], 1.0), ("b", D[0], 3.0)], "sym string, date date, factor double")
    assert sorted(r.factor for r in chain.pipeline(df, ["demean", ("fill_const", 0.0)]).collect()) == [-1.0, 1.0]
    with pytest.raises(KeyError):
        chain.pipeline(df, ["nothing"])
    assert pr.formula_refs("factor + ln(factor) * sym", df.columns) == ["factor", "sym"]
    assert pr.check_formula(df, "factor * 2") and not pr.check_formula(df, "sum(factor)")


def test_profile_counts_null_once_and_takes_nearest(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)] + [(None,)], "x double")
    r = pf.profile(df).first()
    assert (r["count"], r.null_count, r.nunique, r.q25, r.q50, r.q75) == (6, 1, 6, 1.0, 2.0, 3.0)


def test_empty_panel(spark):
    df = spark.createDataFrame([], "sym string, date date, sample int, returns double, group string, marketcap double, factor double")
    data = testers.prepare(df)
    assert testers.ic(data).count() == 0 and testers.bucket_returns(data)["rtn"].count() == 0 and testers.coverage(data).count() == 0


def test_union_and_signature(spark, sf_dir):
    files = pq.manifest(spark, f"{sf_dir}/nation.parquet")
    assert len(pq.signature(files).first()[0]) == 64
    u = pr.union_relaxed([spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit(1.5).alias("a"), F.lit("x").alias("b"))])
    assert sorted(map(tuple, u.collect())) == [(1.0, None), (1.5, "x")]


def test_graph_queries_take_the_whole_edge_table(spark, sf_dir, duck):
    edges = duck.execute("SELECT DISTINCT 'c' || o_custkey, 'p' || l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey").fetchall()
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {r.id: r.component for r in catalog.QUERIES["G-03_components"](spark, sf_dir).collect()} == {x: root(x) for x in up}
    assert sum(r.out_degree for r in catalog.QUERIES["G-02_degree"](spark, sf_dir).collect()) == len(edges)


def test_owners_joined_by_a_long_path_are_not_reported(spark):
    chain_ = spark.createDataFrame([(f"o{i}", f"o{i + 1}") for i in range(24)], "src string, dst string").coalesce(1)
    owners = spark.createDataFrame([("a", "o0"), ("b", "o24"), ("c", "elsewhere")], "id string, owner string")
    found = gr.cross_layer_check(spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"), owners, chain_).collect()
    assert [(r.src, r.dst) for r in found] == [("a", "c")]


def test_ema_by_blocks_equals_the_window(spark):
    rows = [(s, i, None if i % 7 == 3 else float((i * 37 + len(s)) % 11 - 5)) for s, n in (("a", 200), ("bb", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "sym string, date int, x double")
    for span in (1, 2, 5, 12):
        got = ts.with_ema(df, "v", "x", span).withColumn("w", ts.ts_ema("x", span)).collect()
        assert len(got) == len(rows)
        assert all(r.v is None and r.w is None or abs(r.v - r.w) < 1e-9 for r in got)


def test_unions_keep_values_of_mixed_types(spark):
    one = lambda x: spark.range(1).select(x.alias("a"))
    cases = [
        (F.lit(1).cast("long"), F.lit(1.5).cast("float"), "double", [1.0, 1.5]), (F.lit(2).cast("long"), F.lit("2.25").cast("decimal(10,2)"), "decimal(22,2)", [2, 2.25]), (F.lit(1).cast("tinyint"), F.lit(2).cast("int"), "int", [1, 2]),
        (F.lit("2024-01-02").cast("date"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), "timestamp_ntz", [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5)]), (F.lit(True), F.lit("x"), "string", ["true", "x"]), (F.lit(None), F.lit(3), "int", [None, 3]),
    ]
    for a, b, kind, want in cases:
        u = pr.union_relaxed([one(a), one(b)])
        assert u.dtypes == [("a", kind)] and sorted((r.a for r in u.collect()), key=str) == sorted(want, key=str)


def test_profile_of_nothing_is_empty(spark):
    df = spark.range(3).select((F.col("id") > 1).alias("flag"), F.array("id").alias("list"))
    assert pf.profile(df).count() == pf.profile(df, approximate=True).count() == 0
    assert pf.profile(df).columns == pf.profile(df.select(F.lit(1).alias("x"))).columns


def test_streamed_keys_stay_unique_in_the_first_batch(spark, tmp_path):
    from panelweave.streaming.refresh import stream_refresh

    rows = [("a", D[0], 1.0), ("a", D[0], 3.0), ("a", D[0], 2.0), ("b", None, 9.0)]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "sym string, date date, x double")
    df.coalesce(1).write.parquet(source)
    stream_refresh(spark, source, df.schema, root, str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in pq.scan(spark, root).select("sym", "date", "x").collect()] == [("a", D[0], 3.0)]


def test_hash_of_a_set_does_not_hang_on_order(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    h = lambda d: d.agg(pq.set_hash(F.col("x")).alias("h")).first().h
    assert h(df) == h(df.orderBy(F.desc("id")).repartition(7)) != h(df.where("id > 0")) and h(df.union(df)) != h(df)


def test_ranges_merge_into_islands(spark):
    rows = [("a", D[0], D[1]), ("a", D[2], D[3]), ("a", D[5], D[6]), ("a", D[5], D[5]), ("a", D[9], D[8]), ("b", None, D[2]), ("b", D[4], None), ("b", D[1], D[1])]
    got = inc.merge_ranges(spark.createDataFrame(rows, "k string, lo date, hi date"), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", D[0], D[3]), ("a", D[5], D[6]), ("b", None, D[2]), ("b", D[4], None)], key=str)


def test_a_write_runs_its_input_once_and_splits_a_large_bucket(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(400_000).select(F.xxhash64("id").cast("string").alias("sym"), F.expr("date_add(date'2020-01-01', cast(id % 300 as int) + if(id % 10 = 0, 400, 0))").alias("date"), F.rand(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        pq.write_all(df.mapInArrow(count, df.schema), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert seen.value == 400_000
    assert len(list((tmp_path / "t" / "part=2020").glob("*.parquet"))) > 3
    files = [f for f in (tmp_path / "t").rglob("*.parquet")]
    for f in files:
        dates = [r.date for r in spark.read.parquet(str(f)).select("date").collect()]
        assert dates == sorted(dates)
