"""Profiles of several groupings from one scan, against the exact profile of each."""

import datetime as dt

import numpy as np
import pytest

from panelweave.operators import profile as pf


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    data = [(float(v) if v > 0.1 else None, str(k), None if h == 2 else int(h), dt.date(2020, 1, 1 + int(k)), [1]) for v, k, h in zip(rng.random(2000), rng.integers(0, 5, 2000), rng.integers(0, 3, 2000), strict=True)]
    return spark.createDataFrame(data, "v double, k string, h int, d date, other array<int>").repartition(3)


def test_equals_the_exact_profiles(rows):
    groupings = ["all", "k", "h"]
    got = {(r.grouping, r.group, r.field): r for r in pf.profile_sets(rows, groupings).collect()}
    want = {(g, r.group, r.field): r for g, df in pf.profile_many(rows, groupings).items() for r in df.collect()}
    assert got.keys() == want.keys()
    values = np.array(sorted(r.v for r in rows.where("v is not null").collect()))
    for key, w in want.items():
        g = got[key]
        for name in ("data_type", "count", "null_count", "min", "max", "min_date", "max_date"):
            assert g[name] == w[name], (key, name)
        assert abs(g.nunique - w.nunique) <= max(0.2 * w.nunique, 0)
        if w["mean"] is not None:
            assert g["mean"] == pytest.approx(w["mean"])
    g = got["all", "all", "v"]
    for q, at in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(np.searchsorted(values, g[q]) - at * len(values)) <= 2 + len(values) / 1000


def test_one_scan(rows, tmp_path, spark):
    rows.drop("other").write.parquet(str(tmp_path / "t"))
    plan = pf.profile_sets(spark.read.parquet(str(tmp_path / "t")), ["all", "k", "h"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_edges(rows):
    assert pf.profile_sets(rows.limit(0), ["all", "k"]).count() == 0
    assert pf.profile_sets(rows.select("other"), ["all"]).count() == 0
    assert {r.grouping for r in pf.profile_sets(rows, ["h"], ["v"]).collect()} == {"h"}
    with pytest.raises(ValueError, match="no such column"):
        pf.profile_sets(rows, ["nothing"])
