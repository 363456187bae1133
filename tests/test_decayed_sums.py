"""Weighted regressions by blocks against the plain window."""

import datetime as dt

import numpy as np
import pytest

from panelweave.functions import time_series as ts

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for sym, n in (("a", 400), ("b", 61), ("c", 3), (None, 30)):
        for k in range(n):
            x = None if k in (100, 101) else float("nan") if (sym, k) == ("a", 250) else float(rng.normal())
            rows.append((sym, DAY + dt.timedelta(days=k), x, None if k == 20 else float(rng.normal()), "kept"))
    return spark.createDataFrame(rows, "sym string, date date, x double, r double, note string").repartition(3)


@pytest.mark.parametrize(("d", "half_life"), [(1, 5), (2, 1), (10, 5), (60, 20), (120, 1), (1000, 5)])
def test_equals_the_plain_window(panel, d, half_life):
    out = ts.with_weighted_beta(panel, "b", "r", "x", d, half_life)
    assert out.columns == [*panel.columns, "b"]
    rows = out.withColumn("want", ts.ts_weighted_beta("r", "x", d, half_life)).collect()
    assert len(rows) == 494
    for r in rows:
        assert (r.b is None) == (r.want is None), r
        if r.b is not None:
            assert r.b == pytest.approx(r.want, rel=1e-7, abs=1e-9, nan_ok=True)
    if d == 60:
        assert sum(r.b is not None for r in rows) > 100 and any(r.b is not None and np.isnan(r.b) for r in rows)


def test_one_shuffle_and_no_lists(panel):
    plan = ts.with_weighted_beta(panel, "b", "r", "x", 252, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_empty(panel):
    assert ts.with_weighted_beta(panel.limit(0), "b", "r", "x", 5, 5).count() == 0
