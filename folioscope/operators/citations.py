"""The neighbourhood of a work among its citations: what cites it, what it cites, what is related."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Works beside the seed, edges that are shown, and the directions in which an edge may be known.
MOST_WORKS, MOST_EDGES = 30, 180
DIRECTIONS = ("references", "cited_by", "related")


def ranked(lists: DataFrame, most: int = MOST_WORKS) -> DataFrame:
    """Lists (seed, list, direction, place, work) cut to their first works, as (seed, list, direction, works)."""
    first = F.row_number().over(Window.partitionBy("seed", "list").orderBy(F.asc_nulls_last("place"), F.asc_nulls_last("work")))
    cut = lists.withColumn("cut", first).where(F.col("cut") <= most)
    return cut.groupBy("seed", "list", "direction").agg(F.array_sort(F.collect_list(F.struct("cut", "work"))).alias("cuts")).select("seed", "list", "direction", F.col("cuts.work").alias("works"))


def _short(name: Column) -> Column:
    """Two bytes of a work's name."""
    return (F.pmod(F.xxhash64(name), F.lit(1 << 16)) - (1 << 15)).cast("short")


def _shown(lists: DataFrame, most: int) -> DataFrame:
    """A row for each seed: ``names`` of its works in the order of their first sight, ``rounds`` that were run (null: all), and ``held``, the lists' entries of those works."""
    entry = lambda own: lambda work, k: F.struct((k + 1).alias("turn"), own["list"].cast("int").alias("list"), work.alias("work"), own["direction"].alias("direction"))
    once = lambda own: F.transform(F.array_distinct(F.slice(own["works"], 1, most)), entry(own))
    rows = lists.groupBy("seed").agg(F.collect_list(F.struct("list", "direction", "works")).alias("lists"))
    rows = rows.select("seed", F.sort_array(F.flatten(F.transform("lists", once))).alias("turns"))
    rows = rows.withColumn("names", F.slice(F.filter(F.array_distinct("turns.work"), lambda work: work != F.col("seed")), 1, most))
    # The round in which the last place was taken; without it all rounds are run.
    last = F.get(F.filter("turns", lambda t: t["work"] == F.get("names", F.lit(most - 1))), F.lit(0))["turn"]
    held = F.filter("turns", lambda t: F.array_contains("names", t["work"]) | (t["work"] == F.col("seed")))
    return rows.select("seed", "names", last.alias("rounds"), held.alias("held"))


def neighbourhood(lists: DataFrame, references: DataFrame, most: int = MOST_WORKS, most_edges: int = MOST_EDGES, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and directions of the graphs around seeds.

    ``lists`` (seed, list, direction, place, work): for each seed one ranked list a
    direction, numbered by ``list`` in the order in which the directions were asked;
    ``references`` (work, place, referenced): what each work cites, in its order.

    The lists are taken in turn, one work each. A work takes one of the seed's ``most``
    places at first sight, in whatever list; once they are taken only works that are
    shown already count. Rounds end when the places are taken; lists then tell, one after
    the other, which further works of theirs are shown.

    * nodes (seed, node, turn): the seed at 0, then the works by first sight;
    * edges (seed, source, target, direction, turn): lists' edges in that order, then
      references between shown works. An edge is known once: by both ends and, but for
      related works, whichever way it was learned. The first ``most_edges`` are shown;
    * directions (seed, direction, shown, total, truncated).

    A list is read to its ``most``-th work, so that a hub costs no more than another seed.
    Lists may come cut to that work already, as rows or as ``ranked`` gives them, with
    ``totals`` (seed, list, direction, total) of the whole lists; without them the lists are
    counted. Each seed is one row, dealt once; beside it only its works' names are dealt, to
    their references, and what is found comes back.
    """
    shown = _shown(lists if "works" in lists.columns else ranked(lists, most), most)
    seed = F.col("seed")
    nodes = shown.select("seed", F.posexplode(F.concat(F.array("seed"), "names")).alias("turn", "node")).select("seed", "node", "turn")
    early = lambda t: F.col("rounds").isNull() | (t["turn"] <= F.col("rounds"))

    def told(t: Column) -> Column:
        back, soon = t["direction"] == "cited_by", early(t)
        at = F.struct(F.when(soon, 0).otherwise(1).alias("phase"), F.when(soon, t["turn"]).otherwise(t["list"]).alias("x"), F.when(soon, t["list"]).otherwise(t["turn"]).alias("y"))
        ends = F.when(back, t["work"]).otherwise(seed).alias("source"), F.when(back, seed).otherwise(t["work"]).alias("target")
        return F.struct(*ends, t["direction"].alias("direction"), at.alias("at"))

    # Edges need a seed. Its row is read twice, and told apart from others here, so that what is dealt for both is the same.
    own = shown.where("seed is not null")
    # A node takes its seed's names along, two bytes of each, but for those to which an edge is told already; references that may be among them go back to the seed, which tells.
    listed = lambda name: F.transform(F.filter("held", lambda t: t["direction"] == name), lambda t: t["work"])
    every, citing = F.concat("names", F.array("seed")), listed("cited_by")
    short = lambda names, name: F.transform(names, _short).alias(name)
    works = F.array_intersect("names", citing).alias("citing"), F.array_except("names", citing).alias("others"), F.array("seed").alias("itself")
    asked = own.select("seed", *works, short(F.col("names"), "of_citing"), short(every, "of_others"), short(F.array_except(every, listed("references")), "of_itself"))
    beside = lambda name: F.transform(name, lambda work: F.struct(work.alias("work"), F.col(f"of_{name}").alias("short")))
    asked = asked.select("seed", F.inline(F.concat(*map(beside, ("citing", "others", "itself")))))
    cited = references.groupBy("work").agg(F.collect_list(F.struct("referenced", F.col("place").cast("int").alias("place"))).alias("cited"))
    cited = cited.withColumn("names", F.transform("cited.referenced", _short))
    likely = asked.join(cited, "work").where(F.arrays_overlap("short", "names"))
    likely = likely.select("seed", F.struct("work", F.filter("cited", lambda c: F.array_contains("short", _short(c["referenced"]))).alias("cited")).alias("node"))
    found = likely.groupBy("seed").agg(F.collect_list("node").alias("nodes"))
    among = lambda c: F.array_contains("names", c["referenced"]) | (c["referenced"] == seed)
    # The seed's own place is 0, as it is not among the names.
    at = lambda n, c: F.struct(F.lit(2).alias("phase"), F.array_position("names", n["work"]).cast("int").alias("x"), c["place"].alias("y"))
    edge = lambda n: lambda c: F.struct(n["work"].alias("source"), c["referenced"].alias("target"), F.lit("references").alias("direction"), at(n, c).alias("at"))
    between = F.flatten(F.transform("nodes", lambda n: F.transform(F.filter(n["cited"], among), edge(n))))
    both = own.join(found, "seed", "left").select("seed", F.inline(F.concat(F.transform("held", told), F.coalesce(between, F.array()))))
    related = (F.col("direction") == "related").alias("related")
    edges = both.groupBy("seed", "source", "target", related).agg(F.min(F.struct("at", "direction")).alias("first"))
    turn = F.row_number().over(Window.partitionBy("seed").orderBy("first", "source", "target"))
    edges = edges.select("seed", "source", "target", "first.direction", turn.alias("turn")).where(F.col("turn") <= most_edges)
    counts = shown.select("seed", F.explode("held").alias("t")).groupBy("seed", "t.list", "t.direction").agg(F.count("*").alias("shown"))
    totals = lists.groupBy("seed", "list", "direction").agg(F.count("*").alias("total")) if totals is None else totals
    some = F.coalesce("shown", F.lit(0)).cast("long")
    directions = totals.join(counts, ["seed", "list", "direction"], "left").select("seed", "direction", some.alias("shown"), "total", (F.col("total") > some).alias("truncated"))
    return nodes, edges, directions
