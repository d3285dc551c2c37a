"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import ordered, records, retrieval, store
from folioscope.sources.tables import table


def retrieval_ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def retrieval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.index_chunks(table(spark, sf_dir, "documents")).select("page", "chunk", F.length("text").alias("chars"))


def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    by_doc = words.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return by_doc.groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def vector_confident_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.confident_matches(table(spark, sf_dir, "embeddings"))


def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("plain"))


def event_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=1, seconds=86400)
    return out.select("event_id", "user_id", "window_start", "request_count", "allowed")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", gap=86400)
    return out.select("user_id", "session", F.unix_seconds(F.col("begins").cast("timestamp")).alias("begins"), F.unix_seconds(F.col("ends").cast("timestamp")).alias("ends"), "events")


def events_newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5).select("user_id", "place", "event_id", "event_type")


def event_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("last_event"))


def event_carried_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", before.alias("preceding"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    current = base.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 3 = 0 then 'C' else o_orderstatus end"))
    incoming = base.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 5 = 0 then 'I' else o_orderstatus end")).withColumn("o_orderpriority", F.expr("case when o_orderkey % 7 = 0 then 'NEW' else o_orderpriority end"))
    return base, current, incoming


def orders_keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, incoming = _versions(spark, sf_dir)
    return records.keyed_diff(base, incoming, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def orders_three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.three_way_merge(*_versions(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def part_price_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extrema(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey")


def quantity_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = lambda p: lambda n: F.ceil(n * p)
    return ordered.ranked_values(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": rank(0.5), "p95": rank(0.95)})


def customer_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer")
    place = lambda df, c: store.ranked(df.select("c_custkey", c), c, "c_custkey").withColumn("position", F.col("place") - 1)
    return records.fused_ranks([(place(orders, "top"), 1.2), (place(orders, "n"), 1.0), (place(customers, "c_acctbal"), 0.6)], "c_custkey")


def part_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").distinct()
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = joined.groupBy("p_partkey").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    # Spark keeps the first rows of each partition before the exchange: what is gathered is five keys a part.
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy("l_orderkey"))
    first = joined.select("p_partkey", "l_orderkey").withColumn("place", place).where("place <= 5").groupBy("p_partkey")
    first = first.agg(F.array_join(F.array_sort(F.collect_list("l_orderkey")).cast("array<string>"), ",").alias("first_orders"))
    return counts.join(first, "p_partkey")


def document_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("whole"), F.count("*").alias("turns"))


def parts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(50).select("p_partkey", "p_name", "p_retailprice")


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_ranked_passages, retrieval_chunks, token_document_frequency, vector_confident_match, html_plain_text, event_rate_limit, event_sessions, events_newest_per_user, event_upsert_latest,
        event_carried_purchase, orders_keyed_diff, orders_three_way_merge, part_price_extrema, quantity_nearest_rank, customer_rank_fusion, part_backlinks, document_kind_counts, conversation_text, parts_page,
    )
}

_CHUNKS = r"""flat as (select doc_id page, trim(regexp_replace(text, '\s+', ' ', 'g')) s from documents),
chunk as (select page, unnest(range(0, cast(greatest(ceil(greatest(length(s) - 900, 0) / 720.0), 0) as bigint) + 1)) chunk, s from flat where length(s) > 0),
chunks as (select page, cast(chunk as int) chunk, trim(substr(s, chunk * 720 + 1, 900)) text from chunk)"""
_VERSIONS = """base as (select o_orderkey, o_orderstatus, o_orderpriority from orders),
cur as (select o_orderkey, case when o_orderkey % 3 = 0 then 'C' else o_orderstatus end o_orderstatus, o_orderpriority from orders where o_orderkey % 11 <> 0),
inc as (select o_orderkey, case when o_orderkey % 5 = 0 then 'I' else o_orderstatus end o_orderstatus, case when o_orderkey % 7 = 0 then 'NEW' else o_orderpriority end o_orderpriority from orders where o_orderkey % 13 <> 0)"""


def _merged(f: str) -> str:
    c, i = f"(case when c.o_orderkey is null then i.{f} else c.{f} end)", f"(case when i.o_orderkey is null then c.{f} else i.{f} end)"
    return f"case when {i} is not distinct from b.{f} then {c} when {c} is not distinct from b.{f} then {i} else {c} end {f}"


def _clash(f: str) -> str:
    c, i = f"(case when c.o_orderkey is null then i.{f} else c.{f} end)", f"(case when i.o_orderkey is null then c.{f} else i.{f} end)"
    return f"case when {i} is distinct from b.{f} and {c} is distinct from b.{f} and {c} is distinct from {i} then '{f}' end"


ORACLES = {
    "retrieval_ranked_passages": rf"""with {_CHUNKS},
own as (select page, chunk, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) own, regexp_replace(lower(text), '\s+', '', 'g') bare from chunks),
grams as (select page, chunk, own, case when length(bare) >= 3 then list_distinct(list_transform(range(1, length(bare) - 1), lambda i: substr(bare, i, 3))) else [] end g from own),
counts as (select page, chunk, token, count(*) tf from (select page, chunk, unnest(regexp_extract_all(own, '[\p{{L}}\p{{N}}]{{2,}}')) token from own) group by all),
q0 as (select item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) phrase, regexp_replace(lower(text), '\s+', '', 'g') bare from benchmark),
q as (select item_id, phrase, regexp_extract_all(phrase, '[\p{{L}}\p{{N}}]{{2,}}') words, case when length(bare) >= 3 then list_distinct(list_transform(range(1, length(bare) - 1), lambda i: substr(bare, i, 3))) else [] end g from q0),
words as (select item_id, token, count(*) times from (select item_id, unnest(words) token from q) group by all),
df as (select token, count(*) df from counts where token in (select token from words) group by token),
lexical as (select item_id, page, chunk, sum(times * (1 + ln(tf)) * (ln(((select count(*) from chunks) + 1) / (df + 1)) + 1)) lexical, sum(times) matched from counts join words using (token) join df using (token) group by all),
scored as (select q.item_id, page, chunk, case when contains(own, phrase) then 12 else 0 end phrase, case when len(q.g) = 0 or len(grams.g) = 0 then 0.0 else len(list_intersect(q.g, grams.g)) / greatest(len(q.g), len(grams.g)) end sim,
 coalesce(matched / len(words), 0.0) coverage, coalesce(lexical, 0.0) lexical from grams cross join q left join lexical using (item_id, page, chunk) where len(words) > 0),
kept as (select *, round(phrase + 2 * lexical + 4 * coverage + 3 * sim, 9) score from scored where phrase > 0 or coverage >= 0.34 or sim >= 0.1),
ranked as (select *, row_number() over (partition by item_id order by score desc, page, chunk) r, max(score) over (partition by item_id) best from kept)
select item_id, cast(r as int) "rank", page, chunk, round(score, 4) score, cast(floor(score / best * 100 + 0.5) as bigint) relevance from ranked where r <= 5""",
    "retrieval_chunks": f"with {_CHUNKS} select page, chunk, cast(length(text) as int) chars from chunks",
    "token_document_frequency": r"""select token, count(*) documents, cast(sum(tf) as bigint) occurrences from (select doc_id, token, count(*) tf from (select doc_id, unnest(regexp_extract_all(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[\p{L}\p{N}]{2,}')) token from documents) group by all) group by token""",
    "vector_confident_match": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
pairs as (select a.vec_id query_id, b.vec_id vec_id, round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-12), 6) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs),
best as (select query_id, min_by(vec_id, r) vec_id, max(score) score, case when count(*) > 1 then min(score) end next_score from r where r <= 2 group by query_id)
select *, score >= 0.4 and coalesce(score - next_score >= 0.04, true) confident from best""",
    "html_plain_text": r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gis'), '<svg\b[^>]*>.*?</svg\s*>', ' ', 'gis'), '<template\b[^>]*>.*?</template\s*>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&(?:nbsp|#160);', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;|&apos;', '''', 'gi'), '\s+', ' ', 'g')) plain from pages""",
    "event_rate_limit": "with w as (select *, cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 86400 window_start from events), n as (select *, row_number() over (partition by user_id, window_start order by ts, event_id) n from w) select event_id, user_id, window_start, cast(n as int) request_count, n <= 1 allowed from n",
    "event_sessions": "with e as (select *, cast(floor(epoch(ts)) as bigint) s from events), m as (select *, coalesce(s - lag(s) over (partition by user_id order by ts, event_id) > 86400, true) fresh from e), n as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id rows unbounded preceding) session from m) select user_id, cast(session as bigint) session, min(s) begins, max(s) ends, count(*) events from n group by user_id, session",
    "events_newest_per_user": "select user_id, cast(r as int) place, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 5",
    "event_upsert_latest": "select user_id, event_type, (list(value order by ts desc, event_id desc))[1] \"value\", max(event_id) last_event from events group by user_id, event_type",
    "event_carried_purchase": "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) preceding from events",
    "orders_keyed_diff": f"with {_VERSIONS} select o_orderkey, change, case when change = 'changed' then fields else '' end changed_fields from (select coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, concat_ws(',', case when a.o_orderstatus is distinct from b.o_orderstatus then 'o_orderstatus' end, case when a.o_orderpriority is distinct from b.o_orderpriority then 'o_orderpriority' end) fields, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.o_orderstatus is distinct from b.o_orderstatus or a.o_orderpriority is distinct from b.o_orderpriority then 'changed' end change from base a full join inc b on a.o_orderkey = b.o_orderkey) where change is not null",
    "orders_three_way_merge": f"with {_VERSIONS} select b.o_orderkey, {_merged('o_orderstatus')}, {_merged('o_orderpriority')}, concat_ws(',', {_clash('o_orderstatus')}, {_clash('o_orderpriority')}) conflicts from base b left join cur c on c.o_orderkey = b.o_orderkey left join inc i on i.o_orderkey = b.o_orderkey where not ((c.o_orderkey is null and (i.o_orderkey is null or (i.o_orderstatus = b.o_orderstatus and i.o_orderpriority = b.o_orderpriority))) or (i.o_orderkey is null and c.o_orderstatus = b.o_orderstatus and c.o_orderpriority = b.o_orderpriority))",
    "part_price_extrema": "select p_brand, count(*) \"values\", max(p_retailprice) largest, (list(p_partkey order by p_retailprice desc, p_partkey))[1] largest_at, min(p_retailprice) smallest, (list(p_partkey order by p_retailprice, p_partkey))[1] smallest_at from part where p_retailprice is not null group by p_brand having count(*) >= 2",
    "quantity_nearest_rank": "select l_returnflag, percentile_disc(0.5) within group (order by l_extendedprice) p50, percentile_disc(0.95) within group (order by l_extendedprice) p95 from lineitem group by l_returnflag",
    "customer_rank_fusion": "with o as (select o_custkey c_custkey, max(o_totalprice) top, count(*) n from orders group by 1), l as (select c_custkey, 1.2 w, row_number() over (order by top desc, c_custkey) - 1 p from o union all select c_custkey, 1.0, row_number() over (order by n desc, c_custkey) - 1 from o union all select c_custkey, 0.6, row_number() over (order by c_acctbal desc, c_custkey) - 1 from customer) select c_custkey, round(sum(cast(w as double) / (8 + p)), 9) fused, count(*) lists from l group by c_custkey",
    "part_backlinks": "select l_partkey p_partkey, count(distinct o_orderkey) orders, count(distinct o_custkey) customers, list_aggregate(list_slice(list_sort(list(distinct l_orderkey)), 1, 5), 'string_agg', ',') first_orders from lineitem join orders on l_orderkey = o_orderkey group by l_partkey",
    "document_kind_counts": "select source, lang, count(*) documents, cast(sum(length(text)) as bigint) chars from documents group by source, lang",
    "conversation_text": "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn, role, text) whole, count(*) turns from conversations group by conv_id",
    "parts_page": "select p_partkey, p_name, p_retailprice from part order by p_retailprice desc, p_partkey limit 50 offset 50",
}
