"""Ranks by residuals against the solution of the linear system."""

import numpy as np
import pytest

from panelweave.operators import graph as gr


def _solved(n, edges, damping=0.85):
    a, fan = np.zeros((n, n)), np.zeros(n)
    for s, d in edges:
        fan[s] += 1
    for s, d in edges:
        a[d, s] += 1 / fan[s]
    return np.linalg.solve(np.eye(n) - damping * a, np.full(n, (1 - damping) / n))


@pytest.mark.parametrize("tolerance", [1e-3, 1e-7])
def test_within_the_tolerance(spark, tolerance):
    rng = np.random.default_rng(4)
    n = 40
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 35, 90), rng.integers(0, n, 90), strict=True)]  # the last five have no way out
    edges += [(0, i) for i in range(n)] + [(i, 1) for i in range(30)] + edges[:10]  # hubs on both sides, repeated edges
    nodes = spark.createDataFrame([(i,) for i in range(n)] + [(3,), (None,)], "id int")
    table = spark.createDataFrame([*edges, (2, 99), (99, 2), (None, 4), (5, None)], "src int, dst int")
    got = gr.pagerank_push(nodes, table, tolerance=tolerance, hub=7).collect()
    assert len(got) == n
    want = _solved(n, edges)
    off = sum(abs(r.score - want[r.id]) for r in got)
    assert off <= tolerance * 1.0001


def test_edges_of_the_definition(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert gr.pagerank_push(spark.createDataFrame([], "id int"), none).count() == 0
    alone = gr.pagerank_push(spark.createDataFrame([(1,), (2,)], "id int"), none).collect()
    assert sorted((r.id, round(r.score, 12)) for r in alone) == [(1, 0.075), (2, 0.075)]


def test_rounds_do_not_pile_up(spark):
    """Many rounds leave what the nodes pushed since it was last added up, and neither edges nor old residuals."""
    from pathlib import Path

    from panelweave.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*-*"))
    edges = [(i, (7 * i + 3) % 20) for i in range(20)] + [(i, (i + 1) % 20) for i in range(20)]
    got = {r.id: r.score for r in gr.pagerank_push(None, spark.createDataFrame([*edges, (None, 4), (5, None)], "src int, dst int"), tolerance=1e-2).collect()}
    assert sum(abs(got[i] - x) for i, x in enumerate(_solved(20, edges))) <= 1e-2 and len(got) == 20
    left = [p.name.split("-")[0] for p in set(folder.rglob("*-*")) - before if p.is_dir()]
    assert {"links", "fans", "known", "rdd"}.isdisjoint(left) and left.count("residuals") == 1
