"""G: algorithms on edge tables: customers to parts, and the layers of nations, regions and suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import graph as gr
from .registry import query, r, rounded

EDGES = "SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
LAYERS = "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def purchases(spark, sf, repeats=False):
    """Edges of all purchases: customer to part; each once, unless ``repeats`` change nothing for what follows."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    edges = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return edges if repeats else edges.distinct()


def layers(spark, sf):
    edge = lambda t, a, ka, b, kb: table(spark, sf, t).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"))
    return edge("supplier", "s", "s_suppkey", "n", "s_nationkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey")).union(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).distinct()


def nodes(edges):
    return edges.select("src").union(edges.select("dst")).distinct().toDF("id")


_NODES = "n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_STEPS = ", ".join(f"r{i} AS (SELECT id, 0.15 / (SELECT COUNT(*) FROM n) + 0.85 * COALESCE(gain, 0) AS score FROM n LEFT JOIN (SELECT dst AS id, SUM(score / fan) AS gain FROM l JOIN r{i - 1} ON src = r{i - 1}.id GROUP BY 1) USING (id))" for i in range(1, 6))
query("G-01_pagerank", f"WITH e AS ({LAYERS}), {_NODES}, l AS (SELECT src, dst, COUNT(*) OVER (PARTITION BY src) AS fan FROM e), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT COUNT(*) FROM n) AS score FROM n), {_STEPS} SELECT id, {r('score', 10)} AS score FROM r5")(
    lambda spark, sf: rounded(gr.pagerank(nodes(layers(spark, sf)), layers(spark, sf), rounds=5, tolerance=0), 10)
)
_TRADE = f"SELECT src, dst FROM ({EDGES}) UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation"
_PUSHED = _STEPS.replace(_STEPS[_STEPS.index(", r4 AS"):], "")


@query("G-01_pagerank_push", f"WITH e AS ({_TRADE}), {_NODES}, l AS (SELECT src, dst, COUNT(*) OVER (PARTITION BY src) AS fan FROM e), r0 AS (SELECT id, 0.15 / (SELECT COUNT(*) FROM n) AS score FROM n), {_PUSHED} SELECT id, {r('score', 10)} AS score FROM r3")
def trade_ranks(spark, sf):
    """Regions to nations to customers to the parts they buy: three steps from the top, so the fixed point is exact; nations are hubs in parts."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    edge = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"))
    edges = purchases(spark, sf).union(edge(customer, "n", "c_nationkey", "c", "c_custkey")).union(edge(nation, "r", "n_regionkey", "n", "n_nationkey"))
    return rounded(gr.pagerank_push(None, edges, tolerance=1e-13, hub=4), 10)


query("G-02_degree", f"""WITH e AS ({EDGES}), d AS (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
  SELECT id, SUM(i)::BIGINT AS in_degree, SUM(o)::BIGINT AS out_degree, COUNT(*) AS degree FROM d GROUP BY 1""")(
    lambda spark, sf: gr.degree(nodes(purchases(spark, sf)), purchases(spark, sf))
)
# Least labels of neighbours, of which only new ones go on to the next round: no pair of a node and each node it reaches.
_LABELS = """f AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  w AS (SELECT id, id AS label FROM n UNION SELECT f.b, MIN(w.label) FROM w JOIN f ON w.id = f.a GROUP BY 1),
  c AS (SELECT id, MIN(label) AS component FROM w GROUP BY 1)"""
query("G-03_components", f"WITH RECURSIVE e AS ({EDGES}), {_NODES}, {_LABELS} SELECT id, component FROM c")(
    lambda spark, sf: gr.components(None, purchases(spark, sf, repeats=True))
)
query("G-03_component_sizes", f"WITH RECURSIVE e AS ({EDGES}), {_NODES}, {_LABELS} SELECT component, COUNT(*) AS size FROM c GROUP BY 1")(
    lambda spark, sf: gr.component_sizes(gr.components(None, purchases(spark, sf, repeats=True)))
)
_REACH = "w AS (SELECT {start} AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON w.id = e.src WHERE w.depth < 10)"


def _start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


query("G-04_reach", f"WITH RECURSIVE e AS ({LAYERS}), {_REACH.format(start=repr('s1'))} SELECT id, MIN(depth) AS depth FROM w GROUP BY 1")(lambda spark, sf: gr.reach(layers(spark, sf), _start(spark, "s1")))
query("G-04_reach_up", f"WITH RECURSIVE e AS (SELECT dst AS src, src AS dst FROM ({LAYERS})), {_REACH.format(start=repr('r1'))} SELECT id, MIN(depth) AS depth FROM w GROUP BY 1")(lambda spark, sf: gr.reach(layers(spark, sf), _start(spark, "r1"), "up"))
query("G-05_impact", f"WITH RECURSIVE e AS (SELECT dst AS src, src AS dst FROM ({LAYERS})), {_REACH.format(start=repr('r2'))}, m AS (SELECT id, MIN(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1) SELECT SUBSTR(id, 1, 1) AS owner, MIN(depth) AS depth, COUNT(*) AS n_nodes FROM m GROUP BY 1")(
    lambda spark, sf: gr.impact(layers(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes(layers(spark, sf)).select("id", F.substring("id", 1, 1).alias("owner")), _start(spark, "r2"))
)
query("G-06_subgraph", f"WITH e AS ({LAYERS}), k AS (SELECT 'n3' AS id UNION SELECT dst FROM e WHERE src = 'n3' UNION SELECT src FROM e WHERE dst = 'n3') SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")(lambda spark, sf: gr.subgraph(layers(spark, sf), _start(spark, "n3")))


@query("G-07_cross_layer_check", """WITH e AS (SELECT 's' || l_suppkey AS src, 'c' || o_custkey AS dst, 'n' || s_nationkey AS so, 'n' || c_nationkey AS d_o, sn.n_regionkey AS sr, cn.n_regionkey AS cr
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
      JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey)
  SELECT DISTINCT src, dst, so AS src_owner, d_o AS dst_owner FROM e WHERE so <> d_o AND sr <> cr""")
def _cross(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    columns = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()
    own = lambda t, a, k, n: table(spark, sf, t).select(F.concat(F.lit(a), k).alias("id"), F.concat(F.lit("n"), n).alias("owner"))
    owners = own("supplier", "s", "s_suppkey", "s_nationkey").union(own("customer", "c", "c_custkey", "c_nationkey"))
    nation = table(spark, sf, "nation")
    inside = nation.alias("a").join(nation.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")).select(F.concat(F.lit("n"), "a.n_nationkey").alias("src"), F.concat(F.lit("n"), "b.n_nationkey").alias("dst"))
    return gr.cross_layer_check(columns, owners, inside)


query("G-08_topological_levels", f"WITH e AS ({LAYERS}), {_NODES} SELECT id, CASE SUBSTR(id, 1, 1) WHEN 'r' THEN 2 WHEN 'n' THEN 1 ELSE 0 END AS level FROM n")(lambda spark, sf: gr.topological_levels(layers(spark, sf)))



@query("G-08_levels_of_long_chains", "SELECT 'e' || event_id AS id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS level FROM events WHERE user_id IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY user_id) > 1")
def chains(spark, sf):
    """Each event follows the one before it of its user: one chain for each user, as deep as the user has events."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = table(spark, sf, "events").where("user_id is not null").select(F.lag("event_id").over(by_user).alias("src"), F.col("event_id").alias("dst"))
    return gr.topological_levels(before.where("src is not null").select(F.concat(F.lit("e"), "src").alias("src"), F.concat(F.lit("e"), "dst").alias("dst")))
