"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: the larger ones, or the node and its smaller ones.

    The centre of a large family has many neighbours; join_hot() keeps them apart.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        out = join_hot(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        out = join_hot(down, least, ["u"], "n").select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link at most, and that to a node without any: then all are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0] == 0


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) can reach.

    Every round is written to the checkpoint folder; only whether it is the last comes to the
    driver. Rounds double the reach, so long chains need few; they go on until all is settled, as each but the last
    lowers some node's link. Nodes without an edge to another node do not occur; null ends are ignored.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    while not _settled(edges):
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
