"""Registered queries of pooled candidates, citation neighbourhoods and orders as moves, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import citations, moves, pools
from folioscope.operators.components import looked_up
from folioscope.sources.tables import table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as found papers of their customer: days of the month, hours and priorities make the keys that they share."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, who = F.col("o_orderkey"), F.col("c_custkey")
    year, month, day = (f("o_orderdate") for f in (F.year, F.month, F.dayofmonth))
    number = F.concat(F.lpad((who % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(day.cast("string"), 5, "0"))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    doi = F.when(k % 5 == 0, text("https://doi.org/10.48550/arXiv.", number)).when(k % 3 != 0, text("doi:10.5555/C", who.cast("string"), ".", month.cast("string")))
    return orders.select(
        k.alias("arrival"), F.element_at(F.array(*map(F.lit, ("openalex", "s2", "arxiv"))), (k % 3 + 1).cast("int")).alias("source"),
        F.when(k % 4 == 0, "Note").otherwise(text("Report ", F.col("o_orderpriority"), " of ", F.col("c_name"))).alias("title"),
        doi.alias("doi"), F.when(k % 2 == 0, text("arXiv:", number)).alias("arxiv"), F.when(k % 7 == 0, text("s", who.cast("string"), "-", year.cast("string"))).alias("s2"),
        F.when(k % 11 == 0, text("W", who.cast("string"), "x", month.cast("string"))).alias("openalex"),
        F.when(k % 2 == 0, F.array(F.col("c_name"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(k % 3 != 1, year).alias("year"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("venue"), F.repeat(F.lit("x"), (k % 9).cast("int")).alias("abstract"), F.when(k % 4 != 0, k % 100).alias("citations"),
    )


def order_candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each candidate, by its first candidate."""
    return pools.followed(candidates(spark, sf_dir)).select(F.col("arrival").alias("o_orderkey"), "ids.pool")


def order_pooled_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = pools.pooled_papers(pools.pooled(candidates(spark, sf_dir)))
    return papers.withColumn("authors", F.array_join("authors", ";")).withColumn("abstract", F.length("abstract"))


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as works: a part cites the part on the next line of an order, and is related to those of its type. Lists come cut, with their whole sizes.

    Of the related parts the first ones of the type and size are every part's list, but for itself.
    """
    most = citations.MOST_WORKS
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").where("l_orderkey is not null and l_linenumber is not null").repartition("l_orderkey")
    # Lines are dealt once, by order, and what they cite once by the citing part: the lists, the references and the citing parts of others are read from there.
    next_ = F.collect_set(F.struct(F.col("l_partkey").alias("referenced"))).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    pairs = lines.select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("first"), next_.alias("next")).select("work", "first", F.inline("next"))
    cites = pairs.repartition("work").groupBy("work", "referenced").agg(F.min("first").alias("first"))
    references = cites.withColumn("place", F.row_number().over(Window.partitionBy("work").orderBy("first", F.asc_nulls_last("referenced")))).select("work", "place", "referenced")
    listed = lambda rows, number, name: rows.select("seed", F.lit(number).alias("list"), F.lit(name).alias("direction"), "works")
    ordered = lambda place, work: F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(work).alias("work"))))["work"].alias("works")
    counted = lambda rows, number, name: rows.select("seed", F.lit(number).alias("list"), F.lit(name).alias("direction"), "total")

    out = listed(references.where(F.col("place") <= most).groupBy(F.col("work").alias("seed")).agg(ordered("place", "referenced")), 0, "references")
    earliest = F.row_number().over(Window.partitionBy("referenced").orderBy("first", F.asc_nulls_last("work")))
    back = cites.withColumn("n", earliest).where(F.col("n") <= most).groupBy(F.col("referenced").alias("seed")).agg(ordered("n", "work"))
    back = listed(back, 1, "cited_by")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    kinds = parts.groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    # A part that stands n times is no list entry of itself, and one n times of the others.
    own = parts.groupBy("p_type", "p_size", "p_partkey").agg(F.count("*").alias("times"))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("p_type", "p_size").orderBy("p_partkey"))).where(F.col("n") <= most + 1)
    firsts = first.groupBy("p_type", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "times"))).alias("firsts"))
    met = looked_up(own.withColumn("kind", F.struct("p_type", "p_size")), firsts.join(kinds, ["p_type", "p_size"]).select(F.struct("p_type", "p_size").alias("kind"), "firsts", "n"), "kind")
    copies = lambda f: F.array_repeat(f["p_partkey"], F.least(F.col("times") * f["times"], F.lit(most)).cast("int"))
    others = F.filter("firsts", lambda f: f["p_partkey"] != F.col("p_partkey"))
    near = met.select(F.col("p_partkey").alias("seed"), F.slice(F.flatten(F.transform(others, copies)), 1, most).alias("works")).where(F.size("works") > 0)
    near = listed(near.groupBy("seed").agg(F.slice(F.sort_array(F.flatten(F.collect_list("works"))), 1, most).alias("works")), 2, "related")
    totals = counted(cites.groupBy(F.col("work").alias("seed")).agg(F.count("*").alias("total")), 0, "references")
    totals = totals.union(counted(cites.groupBy(F.col("referenced").alias("seed")).agg(F.count("*").alias("total")), 1, "cited_by"))
    others = met.select(F.col("p_partkey").alias("seed"), (F.col("times") * (F.col("n") - F.col("times"))).alias("total")).where("total > 0")
    totals = totals.union(counted(others.groupBy("seed").agg(F.sum("total").alias("total")), 2, "related"))
    return out.union(back).union(near), references, totals


def _part_neighbourhood(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lists, references, totals = _part_graph(spark, sf_dir)
    return citations.neighbourhood(lists, references, totals=totals)


def part_citation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_neighbourhood(spark, sf_dir)[0]


def part_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_neighbourhood(spark, sf_dir)[1]


def part_citation_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_neighbourhood(spark, sf_dir)[2]


def _two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by key, and by date."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("natural"), F.col("o_orderdate").alias("target"))


def customer_order_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest moves that bring a customer's orders from the order of their keys into that of their dates."""
    return moves.key_moves(_two_orders(spark, sf_dir), "o_custkey", "o_orderkey", "natural", "target")


def customer_moved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those moves applied again."""
    orders = _two_orders(spark, sf_dir)
    return moves.moved(orders, customer_order_moves(spark, sf_dir), "o_custkey", "o_orderkey", "natural")


QUERIES = {f.__name__: f for f in (order_candidate_pools, order_pooled_papers, part_citation_nodes, part_citation_edges, part_citation_directions, customer_order_moves, customer_moved_orders)}

_GRAPH = """cites as (select a.l_partkey work, b.l_partkey referenced, min(a.l_orderkey) "first" from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 group by 1, 2),
refs as (select work, referenced, row_number() over (partition by work order by "first", referenced) place from cites),
lists as (select work seed, 0 l, 'references' direction, place, referenced work from refs union all select referenced, 1, 'cited_by', "first", work from cites
 union all select a.p_partkey, 2, 'related', b.p_partkey, b.p_partkey from part a join part b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey <> b.p_partkey),
cuts as (select *, row_number() over (partition by seed, l order by place, work) c from lists qualify c <= 30),
firsts as (select seed, l, direction, work, min(c) c from cuts group by all),
turns as (select *, row_number() over (partition by seed, l order by c) turn from firsts),
sights as (select seed, work, min(turn * 10 + l) at_ from turns where work <> seed group by 1, 2),
shown as (select *, row_number() over (partition by seed order by at_) rank from sights qualify rank <= 30),
rounds as (select seed, max(at_ // 10) filter (rank = 30) r from shown group by seed),
nodes as (select seed, work node, rank turn from shown union all select distinct seed, seed, 0 from lists)"""
_EDGES = """held as (select t.*, r from turns t join nodes n on n.seed = t.seed and n.node = t.work left join rounds o on o.seed = t.seed)"""

ORACLES = {
    "part_citation_nodes": f"with {_GRAPH} select seed, node, cast(turn as int) turn from nodes",
    "part_citation_edges": f"""with {_GRAPH}, {_EDGES},
told as (select seed, case when l = 1 then work else seed end source, case when l = 1 then seed else work end target, direction, case when r is null or turn <= r then 0 else 1 end p, case when r is null or turn <= r then turn else l end x, case when r is null or turn <= r then l else turn end y from held),
between_ as (select a.seed, a.node source, b.node target, 'references' direction, 2 p, a.turn x, f.place y from nodes a join refs f on f.work = a.node join nodes b on b.seed = a.seed and b.node = f.referenced),
every as (select * from told union all select * from between_),
once as (select * from every qualify row_number() over (partition by seed, source, target, direction = 'related' order by p, x, y, direction) = 1)
select seed, source, target, direction, cast(row_number() over (partition by seed order by p, x, y, direction, source, target) as int) turn from once qualify turn <= 180""",
    "part_citation_directions": f"""with {_GRAPH}, {_EDGES}, shown_ as (select seed, l, count(*) n from held group by 1, 2), totals as (select seed, l, direction, count(*) total from lists group by 1, 2, 3)
select t.seed, direction, coalesce(n, 0) shown, total, total > coalesce(n, 0) truncated from totals t left join shown_ s on s.seed = t.seed and s.l = t.l""",
    "customer_moved_orders": "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) place from orders",
}
