"""Connected components of an edge table, as joins and aggregations that contract the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of ``edges`` (columns a, b): component is the least node reachable.

    Each round gives every node the least of itself and its neighbours as parent, follows
    parents, each time twice as far, up to the root, and replaces both ends of each edge by
    their roots; edges inside one tree go. The least node of a component is always its own
    root, so it is what remains. Every root has a child, so a round at least halves the
    nodes, and there are log(n) rounds of log(n) steps at most; stars take one of each.
    Minima are merged before the shuffle; joins by parent are ones that Spark splits when
    one parent has many children. Null ends, loops and repeated edges don't matter.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    live = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        parent = durable(follow(least, least))
        while not parent.where("moved").isEmpty():
            parent = durable(follow(parent, parent))
        rounds.append(parent)
        a = live.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        ab = a.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        live = durable(ab.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return ends.select("node", F.col("node").alias("component"))
    label = reduce(follow, rounds)
    label = label.withColumnsRenamed({"node": "n", "parent": "component"})
    return ends.join(label, ends.node == label.n, "left").select("node", F.coalesce("component", "node").alias("component"))


def follow(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(node, parent, moved): each child's parent replaced by that one's own parent, where it has one; moved if that differs."""
    up = parent.select(F.col("node").alias("via"), F.col("parent").alias("up"))
    return child.join(up, child.parent == up.via, "left").select("node", F.coalesce("up", "parent").alias("parent"), F.coalesce(F.col("up") != F.col("parent"), F.lit(False)).alias("moved"))
