"""Connected components of an edge list, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is its smallest node.

    Each round every component hooks to its smallest neighbour, parents are shortened,
    and the edges are rewritten between components; all of it stays in tables, cut by
    checkpoints. Loops and repeated edges do no harm; nodes without edges do not appear.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("c"), "p")
        parent = cut(parent)
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("g"))
            shorter = cut(parent.join(up, "p").select("c", F.col("g").alias("p"), (F.col("g") < F.col("p")).alias("moved")))
            parent = shorter.select("c", "p")
            if shorter.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("c").alias("node"), F.col("p").alias("component"))
        else:
            hop = parent.select(F.col("c").alias("component"), "p")
            labels = cut(labels.join(hop, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        left, right = parent.select(F.col("c").alias("a"), F.col("p").alias("pa")), parent.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        moved = links.join(left, "a").join(right, "b").where("pa <> pb")
        links = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
