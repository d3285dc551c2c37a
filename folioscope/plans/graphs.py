"""Registered queries of graphs, links and ordered rules, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.functions import text as X
from folioscope.operators import graph, ordered
from folioscope.sources.tables import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (even) and parts (odd) that a line names together, once for each line."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))


def supplier_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("node"))
    return graph.neighbourhood(_edges(spark, sf_dir), seeds)


def supplier_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("node"))
    nodes = graph.neighbourhood(_edges(spark, sf_dir), seeds, hops=2, most=30)
    return graph.induced_edges(_edges(spark, sf_dir), nodes).groupBy("seed").agg(F.count("*").alias("edges"))


def part_relation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relation of a part with its evidence: the order, its place in the list of the part, and the customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    return joined.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "o_custkey", place.alias("place"))


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    link = F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.col("c_mktsegment")).when(k % 4 == 2, F.col("c_custkey").cast("string")).otherwise("nobody")
    return graph.resolved_links(joined.select("o_orderkey", link.alias("link")), table(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", "c_name", "c_mktsegment"]).select("o_orderkey", "state", "target")


def lineitem_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of lines by their key where it is known to the catalogue of large parts, else the first part of the same number of units."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("external"), F.col("l_quantity").cast("int").alias("p_size"))
    exact = parts.where("p_size > 25").select(F.col("p_partkey").alias("external"), F.col("p_partkey").alias("target"))
    out = graph.first_match(rows, exact, parts.select("p_size", F.col("p_partkey").alias("target")), "external", "p_size", "target", "target")
    return out.groupBy("how", "match").agg(F.count("*").alias("rows"))


def customer_interleaved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    by = lambda *c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*c, "o_orderkey"))
    lists = orders.select("o_custkey", "o_orderkey", F.lit(0).alias("list"), by(F.desc("o_totalprice")).alias("place"))
    lists = lists.union(orders.select("o_custkey", "o_orderkey", F.lit(1), by(F.desc("o_orderdate"))))
    return graph.interleaved(lists, "o_custkey", "o_orderkey", "list", "place", 8)


def price_ranked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and lower median, and nearest ranks, of the prices of lines by their flag."""
    rank = lambda p: lambda n: F.ceil(n * p)
    ranks = {"upper": lambda n: F.floor(n / 2) + 1, "lower": lambda n: F.ceil(n / 2), "p50": rank(0.5), "p95": rank(0.95)}
    return ordered.ranked_values(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", ranks)


def event_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("cost"))
    return ordered.within_budget(rows, "user_id", ["ts", "event_id"], "cost", 500).select("event_id", "spent")


def event_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ordered.throttled(rows, "user_id", "ts", "event_id", seconds=86400.0).select("event_id", "kept")


def event_cool_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("limited"), (F.coalesce("value", F.lit(0.0)) * 3600).alias("retry"))
    return ordered.cooled_down(rows, "user_id", "ts", "event_id", "limited", "retry").select("event_id", "asked")


def event_budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "commit").when(F.col("event_id") % 7 == 0, "release").otherwise("reserve")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"), F.floor(F.coalesce("value", F.lit(0.0))).cast("double").alias("amount"))
    return ordered.budget_ledger(rows, "user_id", ["ts", "event_id"], "kind", "amount", 300.0).select("event_id", "verdict")


def event_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("propose", "accept", "reject", "invalidate", "propose"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"))
    return ordered.lifecycle(rows, "user_id", ["ts", "event_id"], "kind").select("event_id", "state")


def event_greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", F.floor("value").alias("score"), (F.col("event_id") * 37 % 400 + 1).alias("cost"))
    out = ordered.greedy_selection(rows, "user_id", "score", "event_id", "cost")
    return out.select("user_id", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"))


def event_following_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(after).alias("following"))


def order_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, partial, failed or waiting: what the parts of a customer's work say together."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.count("*").alias("all"))
    status = F.when(F.col("done") == F.col("all"), "complete").when(F.col("done") > 0, "partial").when(F.col("failed") == F.col("all"), "failed").otherwise("waiting")
    return held.select("o_custkey", status.alias("status"), F.greatest(F.lit(0), F.col("all") - F.col("failed")).alias("analysed"))


def order_stale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line whose status is not theirs."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") != F.col("o_orderstatus")), "left_semi").select("o_orderkey", "o_orderstatus")


def event_owner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def document_prepared_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0)))
    pages = F.ceil(F.greatest(F.length("text"), F.lit(1)) / 1800)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"), sentences.alias("sentences"), (F.length(F.trim("text")) < pages * 24).alias("needs_ocr"))


def conversation_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their first form, the roles that use them in order of first use, their number and where they are last seen."""
    words = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("at", "form"))
    one = words.groupBy(F.lower("form").alias("word"), "role").agg(F.min(F.struct("conv_id", "turn", "at", "form")).alias("first"), F.max("conv_id").alias("last"), F.count("*").alias("uses"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])  # a handful of roles
    return one.groupBy("word").agg(F.min("first").getField("form").alias("form"), F.array_join(roles, ",").alias("roles"), F.sum("uses").alias("uses"), F.max("last").alias("last_seen"))


QUERIES = {
    f.__name__: f
    for f in (
        supplier_neighbourhood, supplier_induced_edges, part_relation_list, order_links, lineitem_first_match, customer_interleaved_orders, price_ranked_values, event_budget_cut,
        event_throttle, event_cool_down, event_budget_ledger, event_lifecycle, event_greedy_selection, event_following_purchase, order_status_rollup, order_stale_evidence, event_owner_names,
        document_prepared_stats, conversation_vocabulary, 
    )
}

_TOKENS = r"regexp_extract_all(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '[\p{{L}}\p{{N}}]{{2,}}')"
_EDGES = "e as (select distinct l_suppkey * 2 a, l_partkey * 2 + 1 b from lineitem), near as (select a, b from e union select b, a from e), s0 as (select s_suppkey * 2 seed, s_suppkey * 2 node, 0 hop from supplier)"


def _hop(k: int, most: int) -> str:
    reached = f"select seed, b node, {k} hop from s{k - 1} join near on node = a where hop = {k - 1}"
    every = f"select seed, node, min(hop) hop from (select * from s{k - 1} union all {reached}) group by seed, node"
    return f"s{k} as (select seed, node, hop from (select *, row_number() over (partition by seed order by hop, node) t from ({every})) where t <= {most})"


ORACLES = {
    "supplier_neighbourhood": f"with {_EDGES}, {', '.join(_hop(k, 100) for k in (1, 2, 3))} select seed, node, hop from s3",
    "supplier_induced_edges": f"with {_EDGES}, {', '.join(_hop(k, 30) for k in (1, 2))} select x.seed, count(*) edges from e join s2 x on e.a = x.node join s2 y on e.b = y.node and x.seed = y.seed group by 1",
    "part_relation_list": "select p p_partkey, l_orderkey, o_custkey, cast(row_number() over (partition by p order by l_orderkey) as int) place from (select distinct l_partkey p, l_orderkey from lineitem) join orders on o_orderkey = l_orderkey",
    "order_links": """with n as (select distinct c_custkey k, lower(trim(cast(x as varchar))) s from (select c_custkey, unnest([cast(c_custkey as varchar), c_name, c_mktsegment]) x from customer)),
o as (select s, count(*) owners, min(k) target from n group by s),
l as (select o_orderkey, case o_orderkey % 4 when 0 then upper(c_name) when 1 then c_mktsegment when 2 then cast(c_custkey as varchar) else 'nobody' end link from orders join customer on c_custkey = o_custkey)
select o_orderkey, case when owners is null then 'unresolved' when owners > 1 then 'ambiguous' else 'resolved' end state, case when owners = 1 then target end target from l left join o on lower(trim(link)) = s""",
    "lineitem_first_match": """with k as (select p_size, min(p_partkey) t from part group by 1), j as (select p.p_partkey a, k.t b from lineitem left join (select * from part where p_size > 25) p on p.p_partkey = l_partkey left join k on k.p_size = cast(l_quantity as int))
select case when a is not null then 'id' when b is not null then 'key' else 'none' end how, coalesce(a, b) "match", count(*) "rows" from j group by 1, 2""",
    "customer_interleaved_orders": """with l as (select o_custkey, o_orderkey, 0 list, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) place from orders
 union all select o_custkey, o_orderkey, 1, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) from orders),
f as (select o_custkey, o_orderkey, min(place * 2 + list) p from l group by 1, 2), t as (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by p, o_orderkey) as int) turn from f)
select * from t where turn <= 8""",
    "price_ranked_values": """with r as (select l_returnflag, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice) r, count(*) over (partition by l_returnflag) n from lineitem where l_extendedprice is not null)
select l_returnflag, max(v) filter (r = floor(n / 2) + 1) upper, max(v) filter (r = ceil(n / 2)) lower, max(v) filter (r = ceil(n * 0.5)) p50, max(v) filter (r = ceil(cast(n as double) * 0.95)) p95 from r group by 1""",
    "event_budget_cut": """select event_id, spent from (select event_id, cast(sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) spent from events where value is not null) where spent <= 500""",
    "event_following_purchase": """select event_id, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) following from events""",
    "order_status_rollup": """with h as (select o_custkey, count(*) filter (o_orderstatus = 'F') d, count(*) filter (o_orderstatus = 'P') f, count(*) n from orders group by 1)
select o_custkey, case when d = n then 'complete' when d > 0 then 'partial' when f = n then 'failed' else 'waiting' end status, greatest(0, n - f) analysed from h""",
    "order_stale_evidence": "select o_orderkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus <> o_orderstatus)",
    "event_owner_names": "select n_name, count(*) events, count(distinct user_id) users from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "document_prepared_stats": """select doc_id, cast(length(text) as int) chars, cast(len(regexp_extract_all(text, '[.!?]+')) as int) sentences, length(trim(text, ' ')) < ceil(greatest(length(text), 1) / 1800.0) * 24 needs_ocr from documents where text is not null""",
    "conversation_vocabulary": """with w as (select conv_id, turn, role, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) form, unnest(range(len(regexp_extract_all(text, '[A-Za-z]{4,}')))) p from conversations where text is not null),
o as (select lower(form) word, role, min({'c': conv_id, 't': turn, 'p': p, 'f': form}) f, max(conv_id) l, count(*) n from w group by 1, 2)
select word, min(f).f form, string_agg(role, ',' order by f, role) roles, cast(sum(n) as bigint) uses, max(l) last_seen from o group by 1""",
}
