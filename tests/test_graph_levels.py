"""Levels of deep graphs against a plain longest-way search, and the rounds that they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import graph as gr


def longest(edges):
    into, nodes = {}, {n for e in edges for n in e}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    level = {}
    while len(level) < len(nodes):
        free = [n for n in nodes - level.keys() if into.get(n, set()) <= level.keys()]
        level |= {n: max((level[a] + 1 for a in into.get(n, ())), default=0) for n in free}
    return level


def levels(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    return {r.id: r.level for r in gr.topological_levels(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Sparse graphs with chains, trees, shared ends, and repeated edges."""
    rng = np.random.default_rng(seed)
    n = 60
    edges = []
    for b in range(1, n):
        for a in rng.integers(max(0, b - 6), b, rng.choice([0, 1, 1, 1, 2, 3])):
            edges.append((f"n{a}", f"n{b}"))
    edges += edges[:5]
    assert levels(spark, edges) == longest(edges)


def test_long_chain_with_side_sources_takes_few_rounds(spark, monkeypatch):
    """20,000 links, each third node with a source of its own beside the chain."""
    n, calls = 20_000, []
    plain = gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: calls.append(1) or plain(df))
    chain = spark.range(n).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    side = spark.range(1, n, 3).select(F.concat(F.lit("s"), "id").alias("src"), F.col("id").cast("string").alias("dst"))
    got = gr.topological_levels(chain.union(side))
    wrong = got.where("level <> if(id like 's%', 0, try_cast(id as int))").count()
    assert (got.count(), wrong) == (n + 1 + side.count(), 0)
    assert len(calls) < 60


def test_cycles_and_empty_tables(spark):
    for edges in ([("a", "b"), ("b", "a")], [("a", "a")], [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]):
        with pytest.raises(ValueError, match="cycle"):
            levels(spark, edges)
    assert levels(spark, [(None, "a"), ("a", None)]) == {}
