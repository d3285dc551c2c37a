"""Registered queries of short list rules, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import lists
from folioscope.sources.tables import table


def order_year_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 1996 and later; those whose date counts as unknown stay."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.year("o_orderdate")).alias("year"))
    return lists.within_years(rows, "year", 1996, None)


def customer_scored_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer: those that are assessed by their score, the others by their number of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("contexts"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    score = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.pmod(F.col("o_totalprice"), F.lit(100.0))).cast("int"))
    order = Window.partitionBy("o_custkey").orderBy(*lists.scored_first(F.col("score"), F.col("contexts")), "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", score.alias("score"), "contexts").withColumn("place", F.row_number().over(order))


def customer_pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's dearest order first, the others in order of their dates."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    best = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("chosen"))
    order = Window.partitionBy("o_custkey").orderBy(*lists.pinned_first(F.col("o_orderkey") == F.col("chosen"), F.col("o_orderdate"), F.col("o_orderkey")))
    return orders.join(best, "o_custkey").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of ten to a book."""
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("document"), (F.col("doc_id") % 10).alias("page"), "text")


def benchmark_page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near a note on the page of its number."""
    notes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("note"), F.floor(F.col("item_id") / 10).alias("document"), (F.col("item_id") % 10).alias("page"))
    lines = _pages(spark, sf_dir).where("text is not null").select("document", "page", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lists.page_sources(notes, lines)


def benchmark_answering_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.floor(F.col("item_id") / 10).alias("document"), (F.col("item_id") % 10).alias("page"), "text")
    return lists.answering_pages(_pages(spark, sf_dir), asked)


def order_lone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only other order of a customer's month, as a paper that surname and year tell."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n"), "o_custkey").alias("surname"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("year"))
    papers = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("paper"), "year", F.array("surname", "surname", F.lit("et")).alias("surnames"))
    return lists.lone_matches(orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("request"), "surname", "year"), papers)


QUERIES = {f.__name__: f for f in (order_year_window, customer_scored_first, customer_pinned_first, benchmark_page_sources, benchmark_answering_pages, order_lone_matches)}

ORACLES = {
    "order_year_window": """with y as (select o_orderkey, case when o_orderkey % 6 <> 0 then cast(year(o_orderdate) as int) end "year" from orders) select * from y where "year" is null or "year" >= 1996""",
    "customer_scored_first": """with l as (select l_orderkey, count(*) contexts from lineitem group by 1), r as (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then cast(floor(o_totalprice % 100) as int) end score, contexts from orders left join l on l_orderkey = o_orderkey)
select *, cast(row_number() over (partition by o_custkey order by score desc nulls last, contexts desc nulls last, o_orderkey) as int) place from r""",
    "customer_pinned_first": """with b as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) = 1 chosen from orders)
select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by not chosen, o_orderdate, o_orderkey) as int) place from b""",
    "benchmark_page_sources": """with w as (select item_id note, item_id // 10 d, item_id % 10 + o.d page, o.n from benchmark, (values (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) o(n, d)),
l as (select doc_id // 10 d, doc_id % 10 page, unnest(range(len(string_split(text, chr(10))))) place from documents where text is not null)
select note, page, cast(place as int) place, cast(row_number() over (partition by note order by n, place) as int) turn from w join l using (d, page) qualify turn <= 120""",
    "benchmark_answering_pages": r"""with q as (select item_id query, item_id // 10 d, item_id % 10 c, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: length(t) >= 2) t from benchmark),
p as (select doc_id // 10 d, doc_id % 10 page, trim(regexp_replace(text, '\s+', ' ', 'g')) x from documents where text is not null), s as (select query, page, cast(len(list_filter(t, lambda w: contains(lower(x), w))) + case when page = c then 1 else 0 end as int) score from q join p using (d) where x <> '')
select *, cast(row_number() over (partition by query order by score desc, page) as int) place from s qualify place <= 4""",
    "order_lone_matches": """with o as (select o_orderkey k, o_custkey c, year(o_orderdate) * 100 + month(o_orderdate) y from orders), u as (select c, y, min(k) p from o where k % 2 = 0 group by 1, 2 having count(*) = 1)
select k request, p paper, cast(0.86 as double) score from o join u using (c, y) where k % 2 = 1""",
}
