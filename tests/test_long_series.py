import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import long_series as ls
from panelweave.functions import time_series as ts
from panelweave.operators import panel as pn
from panelweave.plans import testers

DAY = dt.date(2000, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=int(k))


@pytest.fixture(scope="module")
def returns(spark):
    """Two long symbols, a short one and one without a name; missing returns, total losses, losses beyond everything."""
    rng = np.random.default_rng(7)
    rows = []
    for sym, n in (("a", 400), ("b", 90), ("c", 5), (None, 30)):
        r = rng.normal(0, 0.1, n).round(4)
        r[rng.random(n) < 0.1] = -1
        r[rng.random(n) < 0.05] = -1.5
        there = rng.random(n) > 0.15
        rows += [(sym, day(k * 3), float(v) if ok else None) for k, (v, ok) in enumerate(zip(r, there, strict=True))]
    return spark.createDataFrame(rows, "sym string, date date, r double").repartition(5), rows


def by_symbol(rows):
    out = {}
    for sym, d, r in sorted(rows, key=lambda x: x[1]):
        out.setdefault(sym, []).append((d, r))
    return out


@pytest.mark.parametrize("block_rows", [None, 7, 60])
def test_forward_returns_and_compounds_equal_a_loop(returns, block_rows):
    df, rows = returns
    got = ts.with_compound(ts.fwd_returns(df, "r", (1, 3, 10), block_rows=block_rows), "cum", "r", block_rows=block_rows)
    assert got.columns == ["sym", "date", "r", "d1", "d3", "d10", "cum"]
    got = {(x.sym, x.date): (x.d1, x.d3, x.d10, x.cum) for x in got.collect()}
    assert len(got) == len(rows)
    for sym, series in by_symbol(rows).items():
        for k, (d, r) in enumerate(series):
            want = [np.prod([1 + (v or 0) for _, v in series[k + 1 : k + n + 1]]) - 1 if k + n < len(series) and r is not None and series[k + n][1] is not None else None for n in (1, 3, 10)]
            seen = [v for _, v in series[: k + 1] if v is not None]
            want.append(np.prod([1 + v for v in seen]) - 1 if seen else None)
            assert got[sym, d] == pytest.approx(want, abs=1e-9), (sym, d)


@pytest.mark.parametrize("block_rows", [None, 6])
def test_asof_and_ffill_of_long_symbols_and_null_keys(spark, returns, block_rows):
    df, rows = returns
    member = spark.createDataFrame([("a", day(-5), 1.0), ("a", day(400), 2.0), ("a", day(401), None), ("a", None, 9.0), (None, day(0), 8.0), ("b", day(100), 3.0)], "sym string, date date, x double")
    index = df.union(spark.createDataFrame([("a", None, 5.0), (None, None, 6.0)], df.schema))
    got = pn.asof_panel(index, member, block_rows=block_rows).collect()
    assert len(got) == len(rows) + 2
    for x in got:
        late = x.date is not None and x.date >= day(401)
        want = {"a": None if late else 2.0 if x.date == day(400) else 1.0, "b": 3.0 if x.date and x.date >= day(100) else None}.get(x.sym) if x.date else None
        assert x.x == want, x
    filled = {(x.sym, x.date): x.f for x in ts.with_ffill(df, "f", "r", block_rows=block_rows).collect()}
    for sym, series in by_symbol(rows).items():
        last = None
        for d, r in series:
            last = r if r is not None else last
            assert filled[sym, d] == last


def test_a_long_symbol_is_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, "short").otherwise("long").alias("sym"), F.timestamp_seconds("id").alias("date"), (F.col("id") % 5).cast("double").alias("x"))
    rows, several = ls.blocked(df, "sym", "date", 30_000)
    sizes = {(r.sym, r["__block"]): r["count"] for r in rows.groupBy("sym", "__block").count().collect()}
    assert several and len(sizes) == 7 and max(sizes.values()) < 45_000  # 180,000 rows of one symbol in six blocks
    out = ls.with_running(df, {"s": F.col("x")}, {}, block_rows=30_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sym" in plan and "__block" in plan
    top = out.groupBy("sym").agg(F.max("s").alias("s")).collect()
    assert {r.sym: r.s for r in top} == {"short": 0.0 * 2e4 + float(sum(i % 5 for i in range(0, 200_000, 10))), "long": float(sum(i % 5 for i in range(200_000) if i % 10))}


def test_prepare_takes_other_key_names_and_returns_what_is_computed(spark):
    base = spark.createDataFrame([("a", day(k), 1, 0.1 / 3, "g", 1.0, float(k)) for k in range(4)], "code string, day date, sample int, returns double, group string, marketcap double, factor double")
    got = testers.prepare(base, testers.TestSpec(periods=(1, 2)), keys=("code", "day"))
    assert {"sym", "date", "d1", "d2"} <= set(got.columns)
    assert got.where("d2 is not null").first().d2 == pytest.approx((1 + 0.1 / 3) ** 2 - 1, rel=1e-14)


def test_group_correlation_ties_despite_noise(spark):
    rows = [(day(0), "g" if i % 2 else "h", 0.1 * (i // 2 % 3), 0.1 * (i // 2 % 3) + (100.0 if i % 2 else 0.0), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, group string, d1 double, factor double, sample int")
    got = testers.ic(df, testers.TestSpec(periods=(1,))).first()
    assert got.rank_g1 == pytest.approx(1) and got.r_g1 == pytest.approx(1)
