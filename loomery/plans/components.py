"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.staging import staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component = least node.

    Every edge is turned to point from the larger node to the smaller.  A round
    gives each node its least smaller neighbour as parent (a partial aggregate,
    so hubs do not gather) and rewires its edges to that parent's own parent, or
    to the parent if that has none.  Paths of parents halve each round, so long
    chains take a logarithmic number of rounds in any order of their ids.  Every
    edge that is not a parent's moves to a smaller node, so rounds end: they
    leave a forest, which pointer jumping then flattens.  State is staged as
    Parquet each round.  Null ends and self loops are dropped; repeated edges
    count once.
    """
    big, small = F.greatest(src, dst), F.least(src, dst)
    ends = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    links = staged(ends.select(big.alias("u"), small.alias("v")).filter("u <> v").distinct(), "cc-edges")
    while True:
        parents = links.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n"))
        if not parents.filter("n > 1").limit(1).collect():
            break
        parents = staged(parents.select("u", "p"), "cc-parents")
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = staged(parents.join(up, "p", "left").select("u", "p", F.coalesce("q", "p").alias("q")), "cc-jumped")
        moved = links.join(jumped, "u").filter("v <> p").select(F.col("v").alias("u"), F.col("q").alias("v"))
        links = staged(moved.unionByName(jumped.select("u", F.col("q").alias("v"))).distinct(), "cc-edges")
    tree = links.select("u", F.col("v").alias("p"))
    while True:
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("q"))
        joined = staged(tree.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "cc-tree")
        tree = joined.select("u", "p")
        if not joined.filter("moved").limit(1).collect():
            break
    labels = tree.select(F.col("u").alias("node"), F.col("p").alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)
