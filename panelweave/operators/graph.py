"""Algorithms on edge tables (src, dst) of any size: iterated joins, each round written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf, cut


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id and score after at most ``rounds`` rounds; nodes without out-edges keep their mass to themselves (it is lost)."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    known = edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    links = cut(known.join(known.groupBy("src").agg(F.count(F.lit(1)).alias("fan")), "src"))
    scores = ids.withColumn("score", F.lit(1.0 / n if n else 0.0))
    for i in range(rounds if n else 0):
        gained = links.join(scores.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("fan")).alias("gain"))
        after = scores.withColumnRenamed("score", "before").join(gained, "id", "left").select("id", "before", (F.lit((1 - damping) / n) + damping * F.coalesce("gain", F.lit(0.0))).alias("score"))
        after = cut(after)
        moved = after.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0]
        scores = after.select("id", "score")
        if moved < tolerance:
            break
    return scores


def pagerank_push(nodes: DataFrame | None, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, hub: int = 100_000) -> DataFrame:
    """id and score, off the fixed point of pagerank() by ``tolerance`` at most, added up over all nodes.

    Each node holds a residual that its score lacks yet. In a round only nodes whose residual is over a quarter of the mean one push it:
    their scores take it, their neighbours get the damped shares of it. These nodes hold at least three quarters of what is
    left, so a round takes a fixed share off it, and nodes that have settled do not travel. Edges of a node with more than ``hub``
    of them lie in parts, by their targets; sums at a target are combined before the shuffle. Nodes without out-edges lose their
    mass, edges to unknown or null nodes do not count, repeated edges count as often as they occur. Without ``nodes`` they are all ends of
    edges. Without any there is no row. Disk holds the edges, what the nodes have pushed, and one round.
    """
    shelf = Shelf(edges.sparkSession)
    pairs = edges.select("src", "dst")
    if nodes is None:
        known = shelf.put("known", pairs)
        ids = shelf.put("ids", known.select("src").union(known.select("dst")).toDF("id").where("id is not null").distinct())
        known = known.where("src is not null and dst is not null")
    else:
        ids = shelf.put("ids", nodes.select("id").where("id is not null").distinct())
        known = pairs.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    n = ids.count()
    fans = shelf.put("fans", known.groupBy("src").agg(F.count(F.lit(1)).alias("fan")).withColumn("parts", F.ceil(F.col("fan") / hub).cast("int")))
    wide = fans.where("parts > 1").select("src", "parts")
    parted = known.join(wide, "src", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int"))
    links = shelf.put("links", parted.groupBy("src", "part", "dst").agg(F.count(F.lit(1)).alias("times")))
    shelf.drop("known")
    residuals = shelf.put("residuals", ids.withColumn("residual", F.lit((1 - damping) / n if n else 0.0)))
    scores = ids.withColumn("score", F.lit(0.0))
    rounds = 0
    while n:
        left, holders = residuals.agg(F.sum("residual"), F.count(F.lit(1))).first()
        if left is None or left <= tolerance * (1 - damping):
            break
        rounds += 1
        hot = F.col("residual") > left / (4 * holders)
        active = shelf.put(f"pushed{rounds}", residuals.where(hot))
        shares = active.join(fans.withColumnRenamed("src", "id"), "id").select(F.col("id").alias("src"), (damping * F.col("residual") / F.col("fan")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        gained = links.join(shares, ["src", "part"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("times")).alias("residual"))
        scores = scores.union(active.toDF("id", "score"))
        residuals = shelf.put("residuals", residuals.where(~hot).union(gained).groupBy("id").agg(F.sum("residual").alias("residual")))
        if rounds % 16 == 0:
            scores = shelf.put("scores", scores.groupBy("id").agg(F.sum("score").alias("score")))
            shelf.drop(*(f"pushed{i}" for i in range(rounds - 15, rounds + 1)))
    shelf.drop("links", "fans")
    return scores.union(residuals.toDF("id", "score")).groupBy("id").agg(F.sum("score").alias("score"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree over edges between known nodes."""
    ids = nodes.select("id").distinct()
    known = edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    ends = known.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(known.select("dst", F.lit(1), F.lit(0)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = ids.join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id and component (its least id); without ``nodes`` of all ends of edges, else of these alone. Edges may repeat.

    Each node's edges to its least and its greatest neighbour, two a node at most, are merged first. The edges then take the ids of what
    their ends were merged to, and those within one are gone, mostly all. What is left goes through the same again.
    Of a round only its edges and the map of merged ids stay on disk.
    """
    shelf = Shelf(edges.sparkSession)
    links, everyone = edges.select("src", "dst").toDF("a", "b"), None
    if nodes is not None:
        everyone = shelf.put("everyone", nodes.select("id").distinct())
        links = links.join(everyone.toDF("a"), "a", "left_semi").join(everyone.toDF("b"), "b", "left_semi").select("a", "b")
    links, whole = shelf.put("links", links), None
    while True:
        ends = _both(links).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        ends = shelf.put("ends" if whole is not None or nodes is not None else "everyone", ends)
        if everyone is None:
            everyone = ends.select("id")
        some = ends.select("id", "lo").union(ends.select("id", "hi")).toDF("a", "b").where("a <> b").distinct()
        merged = _merged(shelf, some)
        whole = shelf.put("whole", merged if whole is None else _onwards(whole, merged))
        links = shelf.put("links", _between(links, merged))
        if not links.take(1):
            shelf.drop("links", "ends", "some", "up", "merged")
            return everyone.join(whole, "id", "left").select("id", F.coalesce("anchor", "id").alias("component"))


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select("b", "a"))


def _between(links: DataFrame, merged: DataFrame) -> DataFrame:
    """The edges between what the ids of ``merged`` (id, anchor) were merged to."""
    for end, other in (("a", "b"), ("b", "a")):
        links = links.join(merged.toDF(end, "to"), end, "left").select(F.coalesce("to", end).alias(end), other)
    return links.select("a", "b").where("a <> b").distinct()


def _onwards(first: DataFrame, then: DataFrame) -> DataFrame:
    """One map for two (id, anchor), of which the second has no id of the first."""
    return first.join(then.toDF("anchor", "to"), "anchor", "left").select("id", F.coalesce("to", "anchor").alias("anchor")).union(then)


def _merged(shelf: Shelf, links: DataFrame) -> DataFrame:
    """id and anchor, the least id of its component, of all ids that are not the least of theirs.

    In a round each id goes to its least neighbour if that is less, and from there, by pointer doubling, to the first that stays. An id that stays
    has taken up another one or has a lesser neighbour in the next round: at most half of them are left after two rounds.
    """
    links, whole = shelf.put("some", links), None
    while True:
        up = _both(links).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("anchor")).where("anchor < id")
        up = shelf.put("up", up)
        while up.join(up.select(F.col("id").alias("anchor")), "anchor", "left_semi").take(1):
            up = shelf.put("up", up.join(up.toDF("anchor", "above"), "anchor", "left").select("id", F.coalesce("above", "anchor").alias("anchor")))
        whole = shelf.put("merged", up if whole is None else _onwards(whole, up))
        links = shelf.put("some", _between(links, up))
        if not links.take(1):
            return whole


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def reach(edges: DataFrame, start: DataFrame, direction: str = "down", depth: int | None = None) -> DataFrame:
    """id and depth of what can be reached from ``start`` (id), level by level; the first depth counts, the start has 0."""
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if not front.take(1):
            break
        seen = seen.union(front)
    return seen


def impact(edges: DataFrame, owners: DataFrame, start: DataFrame) -> DataFrame:
    """Downstream nodes of ``start`` and, by ``owners`` (id, owner), the least depth at which each owner is met."""
    return reach(edges, start).where("depth > 0").join(owners, "id").groupBy("owner").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_nodes"))


def subgraph(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges among all nodes up- and downstream of the centres."""
    ids = reach(edges, centres, "down").select("id").union(reach(edges, centres, "up").select("id")).distinct()
    ids = cut(ids)
    return edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").distinct()


def cross_layer_check(column_edges: DataFrame, owners: DataFrame, asset_edges: DataFrame) -> DataFrame:
    """Column edges (src, dst) whose owners differ and have no asset path from one to the other."""
    owned = column_edges.join(owners.toDF("src", "src_owner"), "src").join(owners.toDF("dst", "dst_owner"), "dst").where("src_owner <> dst_owner")
    wanted = cut(owned.select("src_owner", "dst_owner").distinct())
    step = cut(asset_edges.select("src", "dst").distinct())
    paths = cut(wanted.select(F.col("src_owner").alias("root")).distinct().join(step, F.col("root") == F.col("src")).select("root", F.col("dst").alias("at")).distinct())
    front = paths
    while True:
        front = cut(front.join(step, F.col("at") == F.col("src")).select("root", F.col("dst").alias("at")).distinct().join(paths, ["root", "at"], "left_anti"))
        if not front.take(1):
            break
        paths = paths.union(front)
    return owned.join(paths.toDF("src_owner", "dst_owner"), ["src_owner", "dst_owner"], "left_anti").select("src", "dst", "src_owner", "dst_owner")


def topological_levels(edges: DataFrame, share: float = 0.125) -> DataFrame:
    """id and level: the longest way from a node without in-edges. A cycle is an error.

    A node with a single edge left to it lies that edge's length below its source, so such nodes are taken out together where
    they are at least ``share`` of what is left: pointers are doubled up to the nearest node that stays, and edges from
    there carry the length of the way. Otherwise the nodes without in-edges go, and hand their levels on. A chain, a tree or a
    chain with trees at its side thus takes a number of rounds that grows with the logarithm of its length; a graph whose nodes keep
    several ways into them takes a round for each level. Rows with a null end are no edges.
    """
    links = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("w", F.lit(1)))
    nodes = links.select("src").union(links.select("dst")).distinct().toDF("id").withColumn("least", F.lit(0))
    levels, hops, rounds = nodes.limit(0).toDF("id", "level"), [], 0
    while True:
        into = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("src"), F.max("w").alias("w"))
        state = nodes.join(into.withColumnRenamed("dst", "id"), "id", "left")
        kind = F.when(F.col("n").isNull(), "free").when((F.col("n") == 1) & (F.col("least") <= F.col("w")), "single").otherwise("later")
        state = cut(state.withColumn("kind", kind))
        sizes = {k: n for k, n in state.groupBy("kind").count().collect()}
        total, single = sum(sizes.values()), sizes.get("single", 0)
        if not total:
            break
        rounds += 1
        if single and single >= share * total:
            up = _anchors(state.where("kind = 'single'").select("id", F.col("src").alias("anchor"), F.col("w").alias("far")), single)
            hops.append(up)
            stay = links.join(up.select(F.col("id").alias("dst")), "dst", "left_anti").join(up.withColumnRenamed("id", "src"), "src", "left")
            stay = stay.select(F.coalesce("anchor", "src").alias("src"), "dst", (F.col("w") + F.coalesce("far", F.lit(0))).alias("w"))
            links = cut(stay.groupBy("src", "dst").agg(F.max("w").alias("w")))
            nodes = state.where("kind <> 'single'").select("id", "least")
        elif "free" in sizes:
            free = state.where("kind = 'free'").select("id", F.col("least").alias("level"))
            levels = levels.union(free)
            handed = links.join(free.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("level") + F.col("w")).alias("handed"))
            nodes = cut(state.where("kind <> 'free'").select("id", "least").join(handed, "id", "left").select("id", F.greatest("least", "handed").alias("least")))
            links = cut(links.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
            if rounds % 64 == 0:
                levels = cut(levels)  # so that the plan of many levels stays short
        else:
            raise ValueError("the edges have a cycle")
    for up in reversed(hops):
        below = up.join(levels.withColumnRenamed("id", "anchor"), "anchor").select("id", (F.col("level") + F.col("far")).alias("level"))
        levels = cut(levels.union(below))
    return levels


def _anchors(up: DataFrame, n: int) -> DataFrame:
    """``up`` (id, anchor, far) with every anchor replaced by the first one above it that is no id of ``up``, and its distance."""
    span = 1
    while True:
        next_ = up.toDF("anchor", "above", "more")
        after = up.join(next_, "anchor", "left").select("id", F.coalesce("above", "anchor").alias("anchor"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("above").isNotNull().alias("open"))
        after = cut(after)
        up = after.drop("open")
        if not after.where("open").take(1):
            return up
        if span > n:  # a way of more nodes than there are
            raise ValueError("the edges have a cycle")
        span *= 2
