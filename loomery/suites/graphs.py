"""Graphs: one small graph of state transitions per user, and trees over customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import small_graphs as g
from loomery.operators.sqlop import SqlOperator as Op
from loomery.plans import graphs
from loomery.plans.components import connected_components
from loomery.suites.frames import VIEWS, frame, register
from loomery.suites.graph_oracles import oracles

NODES = 6
_EV = "ev AS (" + VIEWS["ev"] + ")"
_EDGES = f", steps AS (SELECT k AS grp, v % {NODES} AS src, lead(v % {NODES}) OVER (PARTITION BY k ORDER BY seq) AS dst, v + 1 AS w FROM ev), edges AS (SELECT grp, src, dst, min(w) AS w FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2, 3)"
_PATHS = ", paths(grp, src, dst, w, hops) AS (SELECT grp, src, dst, w, 1 FROM {e} UNION ALL SELECT p.grp, p.src, e.dst, {agg}(p.w + e.w), p.hops + 1 FROM paths p JOIN {e} e ON p.grp = e.grp AND p.dst = e.src WHERE p.hops < {n} GROUP BY p.grp, p.src, e.dst, p.hops)"
_CLOSURE = ", reach(grp, src, dst) AS (SELECT grp, src, dst FROM edges UNION SELECT r.grp, r.src, e.dst FROM reach r JOIN edges e ON r.grp = e.grp AND r.dst = e.src)"


def _edges(spark, sf_dir):
    return graphs.transition_edges(frame(spark, sf_dir, "ev"), NODES, F.col("v") + 1)


def _dag(spark, sf_dir):
    return _edges(spark, sf_dir).filter("src < dst")


def _named(df):
    return df.withColumnRenamed("group", "grp")


def floydwarshall(spark, sf_dir):
    return _named(graphs.shortest_paths(_edges(spark, sf_dir))).filter("src <> dst")


def dijkstra(spark, sf_dir):
    return _named(graphs.shortest_paths(_edges(spark, sf_dir))).filter("src = 0 and dst <> 0").select("grp", "dst", "w")


def bellmanford(spark, sf_dir):
    """Negative weights on an acyclic graph."""
    return _named(graphs.shortest_paths(_dag(spark, sf_dir).withColumn("w", F.col("w") - 20))).filter("src = 0").select("grp", "dst", "w")


def criticalpath(spark, sf_dir):
    return _named(graphs.longest_paths(_dag(spark, sf_dir))).groupBy("grp").agg(F.max("w").alias("finish"))


def toposort(spark, sf_dir):
    return _named(graphs.topological_levels(_dag(spark, sf_dir)))


def scc(spark, sf_dir):
    return _named(graphs.strong_components(_edges(spark, sf_dir).filter("w > 40")))


def deadlock(spark, sf_dir):
    waits = graphs.reachable(_edges(spark, sf_dir).filter("w > 40"))
    return waits.filter("src = dst").groupBy(F.col("group").alias("grp")).agg(F.max("src").alias("victim"), F.count("*").alias("waiting"))


def pipelinegraph(spark, sf_dir):
    return graphs.reachable(_dag(spark, sf_dir)).groupBy(F.col("group").alias("grp"), "src").agg(F.count("*").alias("downstream"))


def unionfind(spark, sf_dir):
    """Users joined by values: users of one remainder meet in the values they share."""
    ev = frame(spark, sf_dir, "ev")
    return connected_components(ev.select(F.col("k").alias("src"), (F.col("k") % 37 * 1000 + F.col("v") + 10**12).alias("dst")))


def _tree(spark, sf_dir):
    key = F.col("c_custkey")
    return frame(spark, sf_dir, "customer").select((key + 1).alias("node"), F.when(key >= 1, F.floor((key + 1) / 2)).alias("parent"))


def binarylifting(spark, sf_dir):
    up = graphs.ancestors(_tree(spark, sf_dir))
    return up.filter("up = 3").select("node", "ancestor")


def lca(spark, sf_dir):
    up = graphs.ancestors(_tree(spark, sf_dir)).select("node", "ancestor")
    own = _tree(spark, sf_dir).select("node", F.col("node").alias("ancestor"))
    lines = up.unionByName(own)
    other = lines.select((F.col("node") - 1).alias("node"), "ancestor")
    return lines.join(other, ["node", "ancestor"]).groupBy("node").agg(F.max("ancestor").alias("lowest"))


def eulertour(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    below = graphs.ancestors(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("below"))
    return tree.join(below, "node", "left").select("node", (F.coalesce("below", F.lit(0)) + 1).alias("subtree_size"))


def _solved(solve, schema):
    return lambda spark, sf_dir: _named(g.per_graph(_edges(spark, sf_dir), solve, schema))


def _cost(edges):
    cost = [[1000.0] * NODES for _ in range(NODES)]
    for a, b, w in edges:
        cost[a][b] = float(w)
    return cost


def _stable(edges):
    weight = {(a, b): w for a, b, w in edges}
    order = {a: sorted(range(NODES), key=lambda b: (weight.get((a, b), 999), b)) for a in range(NODES)}
    back = {b: sorted(range(NODES), key=lambda a: (-weight.get((a, b), 0), a)) for b in range(NODES)}
    return {"pairs": ",".join(f"{p}-{r}" for p, r in sorted(g.stable_pairs(order, back).items()))}


def _rollback(edges):
    sets = g.RollbackSets()
    half = len(edges) // 2
    first = sum(sets.union(a, b) for a, b, _ in edges[:half])
    more = sum(sets.union(a, b) for a, b, _ in edges[half:])
    sets.rollback(half)
    return {"joined": first + more, "after_rollback": len({sets.find(n) for n in range(NODES)})}


def _trail(edges):
    doubled = edges + [(b, a, w) for a, b, w in edges]
    trail = g.euler_trail(doubled)
    return {"trail_length": -1 if trail is None else len(trail)}


SQL = {
    # The orbit of x -> (x * x + c) mod m: tail and cycle length.
    "floyd": Op(
        """SELECT c, CAST(min(i) AS BIGINT) AS first_repeat, CAST(min(i) - max(j) AS BIGINT) AS cycle_length FROM (SELECT c, i, max(j) AS j FROM (SELECT a.c AS c, a.i AS i, b.i AS j FROM {orbit} a JOIN {orbit} b ON a.c = b.c AND b.i < a.i AND a.x = b.x) p GROUP BY c, i) q WHERE (c, i) IN (SELECT c, min(i) FROM (SELECT a.c AS c, a.i AS i FROM {orbit} a JOIN {orbit} b ON a.c = b.c AND b.i < a.i AND a.x = b.x) r GROUP BY c) GROUP BY c"""
    ),
}
_ORBIT_SPARK = "SELECT c, pos AS i, x FROM (SELECT c, posexplode(aggregate(sequence(1, 60), array(CAST(2 AS BIGINT)), (s, i) -> array_append(s, (element_at(s, -1) * element_at(s, -1) + c) % 97))) AS (pos, x) FROM (SELECT explode(sequence(CAST(1 AS BIGINT), CAST(50 AS BIGINT))) AS c))"
_ORBIT_DUCK = "orbit(c, i, x) AS (SELECT c, 0, CAST(2 AS BIGINT) FROM (SELECT unnest(generate_series(1, 50)) AS c) s UNION ALL SELECT c, i + 1, (x * x + c) % 97 FROM orbit WHERE i < 60)"


def floyd(spark, sf_dir):
    return SQL["floyd"].apply(spark, {"orbit": spark.sql(_ORBIT_SPARK)})


QUERIES = {
    f.__name__: f
    for f in (floydwarshall, dijkstra, bellmanford, criticalpath, toposort, scc, deadlock, pipelinegraph, unionfind, binarylifting, lca, eulertour, floyd)
} | {
    "johnson": lambda spark, sf_dir: floydwarshall(spark, sf_dir).groupBy("grp").agg(F.sum("w").alias("total"), F.count("*").alias("pairs")),
    "dinic": _solved(lambda e: {"flow": g.max_flow(e, 0, NODES - 1)}, "flow long"),
    "maxflow": _solved(lambda e: {"flow": g.max_flow(e, 1, 2)}, "flow long"),
    "articulation": _solved(lambda e: {"points": len(g.cuts(e)["points"])}, "points long"),
    "bridges": _solved(lambda e: {"bridges": len(g.cuts(e)["bridges"])}, "bridges long"),
    "bipartite": _solved(lambda e: {"most": g.matching(e), "greedy": g.greedy_matching(e)}, "most long, greedy long"),
    "hungarian": _solved(lambda e: {"cost": g.assignment(_cost(e))[0]}, "cost double"),
    "hierholzer": _solved(_trail, "trail_length long"),
    "mst": _solved(lambda e: dict(zip(("weight", "trees"), g.spanning_weight(e), strict=True)), "weight long, trees long"),
    "stablematching": _solved(_stable, "pairs string"),
    "dsurollback": _solved(_rollback, "joined long, after_rollback long"),
}



def convexhull(spark, sf_dir):
    """Corners of each user's points (value, sequence)."""
    points = frame(spark, sf_dir, "ev").select(F.col("k").alias("group"), F.col("v").alias("src"), (F.col("seq") % 101).alias("dst"), F.lit(0).alias("w"))
    return _named(g.per_graph(points, lambda e: {"corners": len(g.hull([(a, b) for a, b, _ in e])), "outline": str(g.hull([(a, b) for a, b, _ in e])[:4])}, "corners long, outline string"))


QUERIES["convexhull"] = convexhull

_HEAD = f"WITH RECURSIVE {_EV}{_EDGES}"
_ALL = _HEAD + _PATHS.format(e="edges", agg="min", n=NODES)
_DAG = _HEAD + ", dag AS (SELECT grp, src, dst, w FROM edges WHERE src < dst)"
_PAIRS = "SELECT grp, src, dst, min(w) AS w FROM paths WHERE src <> dst GROUP BY 1, 2, 3"
_HEAVY = _HEAD.replace("GROUP BY 1, 2, 3)", "GROUP BY 1, 2, 3 HAVING min(w) > 40)") + _CLOSURE
ORACLES = {
    "floydwarshall": _ALL + _PAIRS,
    "dijkstra": _ALL + "SELECT grp, dst, min(w) AS w FROM paths WHERE src = 0 AND dst <> 0 GROUP BY 1, 2",
    "johnson": _ALL + f"SELECT grp, CAST(sum(w) AS BIGINT) AS total, count(*) AS pairs FROM ({_PAIRS}) GROUP BY 1",
    "bellmanford": _DAG.replace("src, dst, w FROM edges", "src, dst, w - 20 AS w FROM edges") + _PATHS.format(e="dag", agg="min", n=NODES) + "SELECT grp, dst, min(w) AS w FROM paths WHERE src = 0 GROUP BY 1, 2",
    "criticalpath": _DAG + _PATHS.format(e="dag", agg="max", n=NODES) + "SELECT grp, max(w) AS finish FROM paths GROUP BY 1",
    "toposort": _DAG + _PATHS.format(e="dag", agg="max", n=NODES) + ", nodes AS (SELECT grp, src AS node FROM dag UNION SELECT grp, dst FROM dag) SELECT n.grp, n.node, CAST(coalesce(max(p.hops), 0) AS INTEGER) AS level FROM nodes n LEFT JOIN paths p ON p.grp = n.grp AND p.dst = n.node GROUP BY 1, 2",
    "scc": _HEAVY + ", nodes AS (SELECT grp, src AS node FROM edges UNION SELECT grp, dst FROM edges) SELECT n.grp, n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM nodes n LEFT JOIN (SELECT x.grp, x.src, x.dst FROM reach x JOIN reach y ON x.grp = y.grp AND x.src = y.dst AND x.dst = y.src) a ON a.grp = n.grp AND a.src = n.node GROUP BY 1, 2",
    "deadlock": _HEAVY + "SELECT grp, max(src) AS victim, count(*) AS waiting FROM reach WHERE src = dst GROUP BY 1",
    "pipelinegraph": _HEAD + ", dag AS (SELECT grp, src, dst FROM edges WHERE src < dst)" + _CLOSURE.replace("edges", "dag") + "SELECT grp, src, count(*) AS downstream FROM reach GROUP BY 1, 2",
    "unionfind": f"WITH RECURSIVE {_EV}, e AS (SELECT DISTINCT k AS a, k % 37 * 1000 + v + 1000000000000 AS b FROM ev), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.other = w.a) SELECT node, least(node, min(other)) AS component FROM r GROUP BY node",
    "binarylifting": "SELECT c_custkey + 1 AS node, (c_custkey + 1) // 8 AS ancestor FROM customer WHERE c_custkey + 1 >= 8",
    "lca": "WITH RECURSIVE line(node, ancestor) AS (SELECT c_custkey + 1, c_custkey + 1 FROM customer UNION ALL SELECT node, ancestor // 2 FROM line WHERE ancestor > 1) SELECT a.node, max(a.ancestor) AS lowest FROM line a JOIN line b ON b.node = a.node + 1 AND a.ancestor = b.ancestor GROUP BY 1",
    "eulertour": "WITH RECURSIVE line(node, ancestor) AS (SELECT c_custkey + 1, c_custkey + 1 FROM customer UNION ALL SELECT node, ancestor // 2 FROM line WHERE ancestor > 1) SELECT ancestor AS node, count(*) AS subtree_size FROM line GROUP BY 1",
    "floyd": f"WITH RECURSIVE {_ORBIT_DUCK} " + SQL["floyd"].sql.replace("{orbit}", "orbit"),
}
ORACLES |= oracles(_HEAD, _EV)
