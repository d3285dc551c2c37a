"""Graphs of records: bounded neighbourhoods, links by name, lists taken in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hops and nodes of a neighbourhood.
HOPS, MOST_NODES = 3, 100


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int = MOST_NODES) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` undirected edges (a, b) of each seed (node), nearest first and then by node, ``most`` with the seed.

    Of a node's neighbours no more than twice as many as the most can matter, the smallest ones: hubs are cut to them first.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b")
    # Repeated edges stand together in the order of a node's neighbours, so that no table of all edges is held; Spark cuts hubs before it deals them.
    own = Window.partitionBy("a").orderBy("b")
    near = both.withColumn("turn", F.dense_rank().over(own)).where(F.col("turn") <= 2 * most).withColumn("again", F.lag("b").over(own).eqNullSafe(F.col("b"))).where(~F.col("again")).select("a", "b")
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reached = seen.where(F.col("hop") == hop - 1).join(near, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"))
        every = seen.union(reached.select("seed", "node", F.lit(hop))).groupBy("seed", "node").agg(F.min("hop").alias("hop"))
        order = Window.partitionBy("seed").orderBy("hop", "node")
        seen = every.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, a, b): edges whose two ends both belong to a seed's nodes."""
    ends = nodes.select("seed", F.col("node"))
    first = edges.select("a", "b").distinct().join(ends, F.col("a") == F.col("node")).select("seed", "a", "b")
    return first.join(ends.select(F.col("seed").alias("own"), "node"), (F.col("seed") == F.col("own")) & (F.col("b") == F.col("node"))).select("seed", "a", "b")


def resolved_links(links: DataFrame, nodes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``links`` (with ``link``) and the node that has this id, title or alias: ``resolved``, ``ambiguous`` where several do, ``unresolved`` without any."""
    folded = lambda c: F.lower(F.trim(c))
    known = nodes.select(key, F.explode(F.array_distinct(F.array(*(folded(F.col(n).cast("string")) for n in names)))).alias("name"))
    one = known.groupBy("name").agg(F.count("*").alias("owners"), F.min(key).alias("target"))
    joined = links.join(one, folded(F.col("link")) == F.col("name"), "left")
    state = F.when(F.col("owners").isNull(), "unresolved").when(F.col("owners") > 1, "ambiguous").otherwise("resolved")
    return joined.select(*links.columns, state.alias("state"), F.when(F.col("owners") == 1, F.col("target")).alias("target"))


def first_match(rows: DataFrame, exact: DataFrame, likely: DataFrame, exact_on: str, likely_on: str, target: str, order: str) -> DataFrame:
    """The target of each row by its external id, else the first one (by ``order``) that shares its other key."""
    by_id = exact.groupBy(exact_on).agg(F.min(target).alias("by_id"))
    by_key = likely.groupBy(likely_on).agg(F.min_by(target, order).alias("by_key"))
    joined = rows.join(by_id, exact_on, "left").join(by_key, likely_on, "left")
    return joined.select(*rows.columns, F.coalesce("by_id", "by_key").alias("match"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_key").isNotNull(), "key").otherwise("none").alias("how"))


def interleaved(lists: DataFrame, scope: str, item: str, list_: str, place: str, most: int) -> DataFrame:
    """(scope, item, turn): ranked lists taken in turn, the first sight of an item counts, ``most`` of each scope."""
    first = lists.groupBy(scope, item).agg(F.min(F.struct(place, list_)).alias("at"))
    order = Window.partitionBy(scope).orderBy("at", item)
    return first.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).select(scope, item, "turn")
