"""Sliding quantiles against NumPy and against the plain window; regressions against NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import order_statistics as order
from panelweave.functions import time_series as ts
from panelweave.plans import regress

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Symbols of 700, 300, 3 and 20 (without a name) rows, with gaps and ties."""
    rng = np.random.default_rng(3)
    rows = []
    for sym, n in (("a", 700), ("b", 300), ("c", 3), (None, 20)):
        there = rng.random(n) > 0.1
        rows += [(sym, DAY + dt.timedelta(days=k), float(v) if ok else None, "kept") for k, (v, ok) in enumerate(zip(rng.integers(0, 30, n), there, strict=True))]
    return spark.createDataFrame(rows, "sym string, date date, x double, note string").repartition(4)


def test_kth_smallest_equals_sorting():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 65):
        values = rng.integers(0, 9, n).astype(float)
        start = rng.integers(0, n, 50)
        end = np.array([rng.integers(a + 1, n + 1) for a in start])
        k = np.array([rng.integers(0, b - a) for a, b in zip(start, end, strict=True)])
        want = [np.sort(values[a:b])[i] for a, b, i in zip(start, end, k, strict=True)]
        assert order.kth_smallest(values, start, end, k).tolist() == want


@pytest.mark.parametrize("block_rows", [None, 1, 40])
@pytest.mark.parametrize(("d", "least"), [(1, None), (5, 2), (10, None), (252, 100)])
def test_equals_the_plain_window(panel, d, least, block_rows):
    got = order.with_quantiles(panel, "x", d, {"low": 0.2, "mid": 0.5, "top": 1.0}, least=least, block_rows=block_rows)
    assert got.columns == [*panel.columns, "low", "mid", "top"]
    plain = lambda q: ts.rolling(lambda c: F.percentile(c, F.lit(q)), ["x"], d, least)
    want = panel.withColumns({"low": plain(0.2), "mid": plain(0.5), "top": plain(1.0)})
    rows = lambda df: sorted(tuple("" if v is None else str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert rows(got) == rows(want)


def test_small_runs_reach_back(panel, monkeypatch):
    """Frames that begin in rows handed over before."""
    x = panel.where("sym = 'a'").orderBy("date").toPandas()["x"]
    import pyarrow as pa

    spans = np.minimum(np.arange(1, 701), 9)
    batch = pa.record_batch({"__q_value": pa.array(x, from_pandas=True), "__q_own": [True] * 700, "__q_span": spans})
    monkeypatch.setattr(order, "RUN_ROWS", 1)
    pieces = [batch.slice(i, 7) for i in range(0, 700, 7)]
    run = order._slide([], pa.schema([("m", pa.float64())]), 9, 1, [0.5])
    got = pa.Table.from_batches(list(run(pieces))).column("m").to_pandas()
    np.testing.assert_allclose(got, x.rolling(9, min_periods=1).median())


def test_nan_is_the_largest_and_empty_tables(spark, panel):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=k), v) for k, v in enumerate([1.0, float("nan"), 3.0])], "sym string, date date, x double")
    got = [r.m for r in order.with_quantiles(df, "x", 3, {"m": 0.5}, least=1).orderBy("date").collect()]
    assert got[0] == 1 and np.isnan(got[1]) and got[2] == 3
    assert order.with_quantiles(panel.limit(0), "x", 3, {"m": 0.5}).count() == 0
    assert order.with_quantiles(panel.limit(0), "x", 3, {"m": 0.5}, block_rows=5).count() == 0
    with pytest.raises(ValueError, match="quantiles"):
        order.with_quantiles(panel, "x", 0, {"m": 0.5})


def test_regressions_equal_numpy(spark):
    """Several models by date; dates that are too short, singular or fit perfectly are null."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):
        x, z, u = rng.normal(size=(3, 30))
        rows += [(DAY + dt.timedelta(days=k), *map(float, v)) for v in zip(x - z + 2 * rng.normal(size=30), x, z + 5, u, strict=True)]
    last = DAY + dt.timedelta(days=9)
    rows += [(last, float(v), float(v), 2.0 * v, 0.0) for v in range(9)]  # z is twice x, u constant, y is x
    rows += [(last + dt.timedelta(days=1), 1.0, 2.0, 3.0, 4.0), (DAY, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "day date, y double, x double, z double, u double")
    models = {"one": ["x"], "two": ["x", "z"], "three": ["x", "z", "u"]}
    got = {r.day: r for r in regress.cross_section_models(df, "y", models, date="day").collect()}
    for k in range(4):
        day = DAY + dt.timedelta(days=k)
        data = np.array([r[1:] for r in rows if r[0] == day and None not in r])
        for name, used in models.items():
            a = np.column_stack([np.ones(len(data)), data[:, 1 : 1 + len(used)]])
            beta = np.linalg.lstsq(a, data[:, 0], rcond=None)[0]
            rest = ((data[:, 0] - a @ beta) ** 2).sum()
            t = beta[1] / np.sqrt(rest / (len(a) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
            total = ((data[:, 0] - data[:, 0].mean()) ** 2).sum()
            np.testing.assert_allclose([got[day][f"t_{name}"], got[day][f"r2_{name}"]], [t, 1 - rest / total], rtol=1e-9)
    for day in (last, last + dt.timedelta(days=1)):
        assert set(got[day][1:]) == {None}
