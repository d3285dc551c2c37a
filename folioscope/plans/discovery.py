"""Registered queries of discovery, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.functions import text as X
from folioscope.operators import discovery
from folioscope.sources.tables import table


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as found papers: the same customer's name with its priority is one paper, told of by several orders."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return joined.select(
        k.alias("id"), k.alias("arrival"), F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "c_name").alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("doi:10.1234/"), "c_custkey")).alias("doi"), F.lit(None).cast("string").alias("arxiv"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).alias("venue"), F.when(k % 5 != 0, F.year("o_orderdate")).alias("year"),
        F.expr("repeat('x', cast(o_orderkey % 40 as int))").alias("abstract"), (k % 100).alias("citations"),
    )


def order_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = discovery.candidate_keys(_candidates(spark, sf_dir))
    return keys.groupBy("key").agg(F.count("*").alias("candidates"), F.min("id").alias("first"))


def order_merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("key", E.title_key(F.col("title")))
    return discovery.merged_candidates(rows, "key").withColumn("abstract", F.length("abstract"))


def order_judged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that were judged, by score and then by their fused place, and how many of each customer wait for a judgement."""
    orders = table(spark, sf_dir, "orders")
    judged = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("judged"), (F.col("o_orderkey") % 4).alias("score"))
    joined = orders.join(judged, F.col("o_orderkey") == F.col("judged"), "left")
    waiting = joined.groupBy("o_custkey").agg(F.count_if(F.col("judged").isNull()).alias("waiting"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc("score"), F.desc("o_totalprice"), "o_orderkey")
    best = joined.where("score >= 2").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place")).where("place <= 5")
    return best.join(waiting, "o_custkey")


def order_provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider that answers, by priority, and the failures before it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("answer"))
    place = F.struct("l_linenumber", "l_suppkey")
    best = F.min(F.when(F.col("answer").isNotNull(), place))
    by = lines.groupBy("l_orderkey").agg(best.alias("at"), F.count_if(F.col("answer").isNull()).alias("failures"), F.count("*").alias("asked"))
    status = F.when(F.col("failures") == 0, "complete").when(F.col("failures") == F.col("asked"), "failed").otherwise("partial")
    return by.select("l_orderkey", F.col("at.l_suppkey").alias("provider"), "failures", status.alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        order_candidate_keys, order_merged_candidates, order_judged_list, order_provider_fallback, 
    )
}

_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_FOUND = """c as (select o_orderkey id, concat_ws(' ', c_mktsegment, o_orderpriority, c_name) title, case when o_orderkey % 3 = 0 then '10.1234/' || c_custkey end doi, case when o_orderkey % 2 = 0 then o_orderpriority end venue,
 case when o_orderkey % 5 <> 0 then cast(year(o_orderdate) as int) end "year", o_orderkey % 40 abstract, o_orderkey % 100 citations from orders join customer on o_custkey = c_custkey)"""

ORACLES = {
    "order_candidate_keys": f"""with {_FOUND}, k as (select id, 'doi:' || doi k from c where doi is not null union all select id, 'title:' || {_KEY.format('title')} from c where length({_KEY.format('title')}) >= 12) select k as "key", count(*) candidates, min(id) "first" from k group by 1""",
    "order_merged_candidates": f"""with {_FOUND} select {_KEY.format('title')} as "key", count(*) members, (list(venue order by id) filter (venue is not null))[1] venue, (list("year" order by id) filter ("year" is not null))[1] "year", cast(max(abstract) as int) abstract, max(citations) citations from c group by 1""",
    "order_judged_list": """with w as (select o_custkey, count(*) filter (o_orderkey % 3 <> 0) waiting from orders group by 1),
p as (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey % 4 desc, o_totalprice desc, o_orderkey) as int) place from orders where o_orderkey % 3 = 0 and o_orderkey % 4 >= 2) select * from p join w using (o_custkey) where place <= 5""",
    "order_provider_fallback": """with a as (select l_orderkey, min({'n': l_linenumber, 's': l_suppkey}) filter (l_returnflag <> 'R') p, count(*) filter (l_returnflag = 'R') f, count(*) n from lineitem group by 1)
select l_orderkey, p.s provider, f failures, case when f = 0 then 'complete' when f = n then 'failed' else 'partial' end status from a""",
}
