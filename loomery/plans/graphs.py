"""Graph plans over edge tables, many graphs at once: a ``group`` column tells them apart.

Closures and distances are repeated self-joins with a partial aggregate that
stop when nothing changes; each round is staged, so lost executors cost one
round.  Each round doubles the hops covered.  Algorithms whose state is one whole graph run per group in one Arrow
batch (:mod:`loomery.operators.small_graphs`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.errors import Stopped
from loomery.sources.staging import staged


def _settle(start: DataFrame, best, keys: list[str], value: str, rounds: int) -> DataFrame:
    """Join paths to paths until no best value changes."""
    now = staged(start.groupBy(*keys).agg(best(value).alias(value)), "paths")
    group, src, dst = keys
    for _ in range(rounds):
        other = now.select(group, F.col(src).alias(dst), F.col(dst).alias("_end"), F.col(value).alias("_more"))
        longer = now.join(other, [group, dst]).select(group, src, F.col("_end").alias(dst), (F.col(value) + F.col("_more")).alias(value))
        after = staged(now.unionByName(longer).groupBy(*keys).agg(best(value).alias(value)), "paths")
        if not after.exceptAll(now).limit(1).collect():
            return after
        now = after
    raise Stopped("distances still change: a negative cycle, or more rounds are needed")


def shortest_paths(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(group, src, dst, w)``: least weight of a path of one edge or more; raises Stopped on a negative cycle."""
    loops = edges.filter("src = dst and w < 0").limit(1).collect()
    if loops:
        raise Stopped("a negative loop")
    return _settle(edges.select("group", "src", "dst", "w"), F.min, ["group", "src", "dst"], "w", rounds)


def longest_paths(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(group, src, dst, w)`` of an acyclic graph; raises Stopped on a cycle of positive weight."""
    return _settle(edges.select("group", "src", "dst", "w"), F.max, ["group", "src", "dst"], "w", rounds)


def reachable(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(group, src, dst)`` of all pairs joined by a path of one edge or more."""
    flat = edges.select("group", "src", "dst", F.lit(0).alias("w"))
    return _settle(flat, F.min, ["group", "src", "dst"], "w", rounds).drop("w")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(group, node, component)``: nodes that reach each other share the least of them."""
    pairs = reachable(edges)
    back = pairs.select("group", F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = edges.select("group", F.col("src").alias("node")).union(edges.select("group", "dst")).distinct()
    both = pairs.join(back, ["group", "src", "dst"]).groupBy("group", F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes.join(both, ["group", "node"], "left").select("group", "node", F.least("node", F.coalesce("least", "node")).alias("component"))


def ancestors(parents: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, ancestor, up)`` for every proper ancestor, from ``(node, parent)``; roots have a null parent."""
    edges = parents.filter("parent is not null").select(F.lit(0).alias("group"), F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit(1).alias("w"))
    return shortest_paths(edges, rounds).select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.col("w").alias("up"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """``(group, node, level)``: edges on the longest path that leads to the node; raises Stopped on a cycle."""
    ones = edges.select("group", "src", "dst", F.lit(1).alias("w"))
    deep = longest_paths(ones).groupBy("group", F.col("dst").alias("node")).agg(F.max("w").alias("level"))
    nodes = edges.select("group", F.col("src").alias("node")).union(edges.select("group", "dst")).distinct()
    return nodes.join(deep, ["group", "node"], "left").select("group", "node", F.coalesce("level", F.lit(0)).alias("level"))


def transition_edges(events: DataFrame, nodes: int, weight: Column) -> DataFrame:
    """Edges between the states ``v % nodes`` of one user's consecutive events, lightest of parallels."""
    from pyspark.sql import Window

    state = F.col("v") % nodes
    after = F.lead(state).over(Window.partitionBy("k").orderBy("seq"))
    steps = events.select(F.col("k").alias("group"), state.alias("src"), after.alias("dst"), weight.alias("w"))
    return steps.filter("dst is not null and src <> dst").groupBy("group", "src", "dst").agg(F.min("w").alias("w"))
