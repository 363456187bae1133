"""Components of odd graphs against a plain union of sets, and what their rounds leave on disk."""

import random
from pathlib import Path

from panelweave.operators import graph as gr
from panelweave.session import shared_folder


def _want(ids, edges):
    at = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(at[a], at[b])
            moved |= at[a] != low or at[b] != low
            at[a] = at[b] = low
    return at


def _random(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_least_id_of_all_reached(spark):
    """Chains, chains whose ids go up and down, stars with a great centre, random graphs and loops, side by side."""
    graphs = [
        [(i, i + 1) for i in range(60)],
        [(i, 100 + i) for i in range(30)] + [(100 + i, i + 1) for i in range(30)],
        [(1000 + j, 20 * j + i) for j in range(4) for i in range(20)] + [(0, 25)],
        _random(80, 60, 1), _random(60, 300, 2) * 2, [(5, 5), (7, 6), (6, 7)],
    ]
    edges = [(10_000 * k + a, 10_000 * k + b) for k, g in enumerate(graphs) for a, b in g]
    table = spark.createDataFrame([*edges, (None, 3), (-4, None)], "src long, dst long")
    want = _want({i for e in edges for i in e} | {3, -4}, edges)
    assert {r.id: r.component for r in gr.components(None, table).collect()} == want | {None: None}
    ids = {i for i in want if i % 9} | {5000}
    known = spark.createDataFrame([(i,) for i in ids], "id long")
    inside = [(a, b) for a, b in edges if a in ids and b in ids]
    assert {r.id: r.component for r in gr.components(known, table).collect()} == _want(ids, inside)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert gr.components(None, none).count() == 0
    assert [tuple(r) for r in gr.components(spark.createDataFrame([(3,)], "id long"), none).collect()] == [(3, 3)]


def test_rounds_do_not_pile_up(spark):
    """Of a graph that takes several rounds, the labels' two tables stay and no stored edges."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p for p in folder.rglob("*") if p.is_dir()}
    got = gr.components(None, spark.createDataFrame(_random(400, 500, 3), "src long, dst long"))
    left = {p for p in folder.rglob("*") if p.is_dir()} - before
    assert got.count() > 300
    assert sorted(p.name.split("-")[0] for p in left) == ["everyone", "shelf", "whole"]
