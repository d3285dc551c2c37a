"""Registered queries of the library's rules and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import library
from folioscope.sources.tables import table

#: Characters of the texts that are dealt to one part.
PART_CHARS = 1 << 24
STATES = {"P": 0, "O": 1, "F": 2}


def document_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), X.tokens(F.col("text")).alias("terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return library.prefix_search(docs, asked)


def document_text_from_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The texts are dealt, not their words, which stay where they are; in parts whose words fit into memory.
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = docs.repartition(max(spark.sparkContext.defaultParallelism, chars // PART_CHARS), "doc_id")
    placed = dealt.select("doc_id", F.sort_array(F.transform(X.tokens(F.col("text")), lambda w, k: F.struct(w.alias("word"), k.alias("at")))).alias("placed"))
    first = lambda k: (k == 0) | (F.get("placed", k)["word"] != F.get("placed", k - 1)["word"])
    begins = F.when(F.size("placed") > 0, F.filter(F.sequence(F.lit(0), F.size("placed") - 1), first))
    words = placed.select("doc_id", "placed", begins.alias("begins"))
    own = lambda k, turn: F.slice("placed", k + 1, F.coalesce(F.get("begins", turn + 1), F.size("placed")) - k)
    lists = F.transform("begins", lambda k, turn: F.struct(F.get("placed", k)["word"].alias("word"), F.transform(own(k, turn), lambda x: x["at"]).alias("positions")))
    return library.text_from_positions(words.select("doc_id", F.inline(lists)), "doc_id")


def document_content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.content_versions(table(spark, sf_dir, "documents"), "doc_id", "text")


def customer_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return library.cascade(roots, orders, "c_custkey", F.col("o_orderpriority") == "1-URGENT")


def lineitem_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    beyond = lines.where("l_discount > 0.09 or l_quantity <= 0").select(F.lit("out of bounds").alias("fault"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")).distinct()
    faults = [library.repeated(lines, ["l_orderkey", "l_linenumber"], "repeated"), library.dangling(lines, "l_partkey", parts, "p_partkey", "no part"), library.dangling(lines, "l_orderkey", orders, "o_orderkey", "no order")]
    for one in faults:
        beyond = beyond.union(one)
    return beyond


def conversation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [library.csv_cell(F.col(c)) for c in ("conv_id", "turn", "role", "text")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", *cells).alias("line"))


def event_absorbing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.floor("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(library.absorbing_sum(value).alias("total"), F.count("*").alias("events"))


def order_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.state_snapshot(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", STATES)


def customer_snapshot_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.snapshot_token(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


QUERIES = {
    f.__name__: f
    for f in (
        document_prefix_search, document_text_from_positions, document_content_versions, customer_delete_cascade, lineitem_violations,
        conversation_csv, event_absorbing_totals, order_state_snapshot, customer_snapshot_token,
    )
}

_TOKENS = r"regexp_extract_all(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[\p{L}\p{N}]{2,}')"
_CELL = "case when regexp_matches({0}, '[\",\\n\\r]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"

ORACLES = {
    "document_prefix_search": f"""with t as (select item_id, unnest(list_distinct({_TOKENS})) term from benchmark),
d as (select doc_id, unnest(list_distinct({_TOKENS})) token from documents),
k as (select distinct item_id, term, doc_id from (select distinct term from t) join (select distinct token from d) on starts_with(token, term) join d using (token) join t using (term)),
n as (select item_id, count(*) needed from t group by item_id),
h as (select item_id, doc_id from k join n using (item_id) group by item_id, doc_id having count(*) = any_value(needed)),
r as (select *, row_number() over (partition by item_id order by doc_id desc) place from h)
select item_id query, cast(place as int) place, doc_id page from r where place <= 100""",
    "document_text_from_positions": f"select doc_id, array_to_string(list_slice({_TOKENS}, 1, 5000), ' ') \"text\" from documents where len({_TOKENS}) > 0",
    "document_content_versions": "select sha256(coalesce(text, '')) \"hash\", min(doc_id) \"first\", count(*) copies from documents group by 1",
    "customer_delete_cascade": """with h as (select o_custkey, count(*) held, bool_or(o_orderpriority = '1-URGENT') bound from orders group by 1)
select c_custkey, case when coalesce(bound, false) then 'refused' else 'deleted' end outcome, case when coalesce(bound, false) then 0 else coalesce(held, 0) end children from customer left join h on c_custkey = o_custkey where c_acctbal < 0""",
    "lineitem_violations": """select distinct 'out of bounds' fault, l_orderkey || ':' || l_linenumber id from lineitem where l_discount > 0.09 or l_quantity <= 0
union all select 'repeated', l_orderkey || ':' || l_linenumber from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all select distinct 'no part', cast(l_partkey as varchar) from lineitem where l_partkey not in (select p_partkey from part)
union all select distinct 'no order', cast(l_orderkey as varchar) from lineitem where l_orderkey not in (select o_orderkey from orders)""",
    "conversation_csv": "select conv_id, turn, " + " || ',' || ".join(_CELL.format(f"coalesce(cast({c} as varchar), '')") for c in ("conv_id", "turn", "role", "text")) + " line from conversations",
    "event_absorbing_totals": "with v as (select user_id, case when event_type <> 'error' then cast(floor(value) as bigint) end v from events) select user_id, case when count(*) = count(v) then cast(sum(v) as bigint) end total, count(*) \"events\" from v group by user_id",
    "order_state_snapshot": """with r as (select o_orderstatus, row_number() over (order by case o_orderstatus when 'P' then 0 when 'O' then 1 when 'F' then 2 else 3 end, o_orderkey) r from orders)
select o_orderstatus state, count(*) filter (r <= 64) shown, count(*) filter (r > 64) remaining from r group by 1""",
    "customer_snapshot_token": "select o_custkey, sha256(string_agg(sha256(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), '' order by o_orderkey)) token from orders group by 1",
}
