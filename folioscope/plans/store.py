"""Registered queries of record tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import store
from folioscope.sources.tables import table

DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


def event_customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return store.lookup(asked, table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", ["c_name"])


def orders_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.filtered(table(spark, sf_dir, "orders"), {"o_orderstatus": "O", "o_orderpriority": None, "o_custkey": None})
    out = store.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], limit=1000, offset=20)
    return out.select("o_orderkey", "o_totalprice", "place", "has_next")


def event_page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", store.clamped_limit(value).alias("page_limit"), store.clamped_offset(value - 50).alias("page_offset"))


def event_json_path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get_json_object("props", "$.k").cast("int").alias("k")
    rows = table(spark, sf_dir, "events").select("event_id", path).where("k is not null")
    return rows.groupBy("k").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))


def event_decoded_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad JSON reads as an empty object."""
    broken = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    decoded = F.coalesce(F.try_parse_json(broken), F.parse_json(F.lit("{}")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(decoded, "$.k", "int").alias("k"), F.to_json(decoded).alias("metadata"))


def customer_ranked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"))


def customer_newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.count("*").alias("orders"))
    return customers.join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "newest", "orders")


def lineitem_checked_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"),
        (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("l_orderkey"),
        (F.col("l_partkey") - F.when(F.col("l_quantity") > 49, 10_000_000).otherwise(0)).alias("l_partkey"),
    )
    existing = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))
    references = [("l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey"), ("l_partkey", table(spark, sf_dir, "part"), "p_partkey")]
    return store.checked_insert(lines, "id", existing, references).groupBy("outcome").agg(F.count("*").alias("lines"), F.count_distinct("id").alias("ids"))


def orders_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    moved = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 3, 100_000_000).otherwise(0)
    expected = F.when(F.col("o_orderkey") % 4 == 0, F.lit("P")).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderstatus"))
    updates = orders.select(moved.alias("o_orderkey"), expected.alias("expected"), F.lit("X").alias("value"))
    return store.guarded_update(orders, updates, "o_orderkey", "o_orderstatus")


def orders_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    changes = orders.where("o_orderkey % 3 = 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, "NEW").alias("o_orderpriority")
    )
    return store.partial_update(orders, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def customer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    newer = F.when(F.col("o_totalprice") > 300000, "LARGE").otherwise("SMALL")
    incoming = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("c_custkey")).agg(F.max(newer).alias("c_mktsegment"))
    return store.upserted(customers, incoming, "c_custkey", ["c_mktsegment"])


def part_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    incoming = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("p_partkey")).distinct().withColumn("p_brand", F.lit("new"))
    return store.inserted_or_ignored(rows, incoming, "p_partkey")


def event_insert_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inserted_below(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 5).select("event_id", F.col("held").cast("int").alias("held"), "inserted")


def orders_merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current, incoming = _versions(table(spark, sf_dir, "orders"))
    return store.merged_records(base, current, incoming, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def orders_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    patch = orders.where(k % 3 == 0).select(
        F.when(k % 9 == 0, k + 100_000_000).otherwise(k).alias("o_orderkey"),
        F.when(k % 2 == 0, "set").when(k % 5 == 0, "add").otherwise("remove").alias("op"),
        F.lit("X").alias("value"),
    )
    return store.patched(orders, patch, "o_orderkey", "o_orderstatus")


def orders_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current, _ = _versions(table(spark, sf_dir, "orders"))
    scan = current.where("o_orderkey % 17 <> 0").unionByName(base.select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_orderstatus", "o_orderpriority"))
    return store.reconciled(base, scan, "o_orderkey", "o_orderstatus")


def orders_import_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    moved = F.when(k % 7 == 0, k + 100_000_000).when(k % 11 == 0, k - 1).otherwise(k)
    batch = orders.select(
        moved.alias("o_orderkey"), F.when(k % 13 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), k.alias("turned"),
    )
    out = store.classified_import(batch, orders, "o_orderkey", ["o_orderstatus"], "turned", ("o_custkey", table(spark, sf_dir, "customer"), "c_custkey"))
    return out.select("turned", "o_orderkey", "class")


def orders_merged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    dear = rows.where("o_totalprice > 100000")
    late = rows.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return store.merged_pages(dear, late, "o_orderkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


def event_generation_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("generation"))
    return store.current_generation(rows, "user_id", ["ts", "event_id"], "generation").select("event_id", "late")


def lineitem_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("revision"))
    out = store.stale(lines, "l_orderkey", "revision", table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"), "o_orderkey", "o_orderstatus")
    return out.groupBy("state", "revision").agg(F.count("*").alias("lines"))


def orders_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    exact = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return store.preferred(rows, "o_custkey", exact, F.col("o_orderstatus") == "P", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


def event_snapshot_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    asked = rows.where("event_type = 'purchase'").select("event_id", "user_id")
    return store.snapshot_window(rows, "user_id", ["ts", "event_id"], asked, "event_id").select("event_id", "outcome")


def event_recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred of all scopes, listed with their place in their own."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    order = store.Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_id", F.row_number().over(order).alias("place"))


def orders_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 200 entries a priority would evict: the least recently used."""
    order = store.Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    aged = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate").withColumn("age", F.row_number().over(order))
    return aged.where("age > 200").groupBy("o_orderpriority").agg(F.count("*").alias("evicted"), F.max("o_orderdate").alias("newest_evicted"))


def _versions(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    current = base.where(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 3 == 0, "C").otherwise(F.col("o_orderstatus")))
    incoming = base.where(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, "I").otherwise(F.col("o_orderstatus")))
    return base, current, incoming.withColumn("o_orderpriority", F.when(k % 7 == 0, "NEW").otherwise(F.col("o_orderpriority")))


QUERIES = {
    f.__name__: f
    for f in (
        event_customer_lookup, orders_filtered_page, event_page_bounds, event_json_path_index, event_decoded_props, customer_ranked_list, customer_newest_orders, lineitem_checked_insert,
        orders_guarded_update, orders_partial_update, customer_upsert, part_insert_or_ignore, event_insert_below, orders_merged_records, orders_patch, orders_reconcile, orders_import_classes,
        orders_merged_page, event_generation_drop, lineitem_stale, orders_preferred, event_snapshot_bases, event_recents, orders_eviction,
    )
}

_VERSIONS = """base as (select o_orderkey, o_orderstatus, o_orderpriority from orders),
cur as (select o_orderkey, case when o_orderkey % 3 = 0 then 'C' else o_orderstatus end o_orderstatus, o_orderpriority from orders where o_orderkey % 11 <> 0),
inc as (select o_orderkey, case when o_orderkey % 5 = 0 then 'I' else o_orderstatus end o_orderstatus,
 case when o_orderkey % 7 = 0 then 'NEW' else o_orderpriority end o_orderpriority from orders where o_orderkey % 13 <> 0)"""

ORACLES = {
    "event_customer_lookup": """select k.user_id c_custkey, c_name, c_custkey is not null found
from (select distinct user_id from events where user_id is not null) k left join customer on c_custkey = k.user_id""",
    "orders_filtered_page": """with r as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 20 place, count(*) over () n from orders where o_orderstatus = 'O')
select o_orderkey, o_totalprice, cast(place as int) place, n > 120 has_next from r where place between 1 and 100""",
    "event_page_bounds": """with v as (select event_id, case when event_type = 'error' then null else value end v from events)
select event_id, case when v is null then 50 else cast(least(greatest(floor(v), 1), 100) as int) end page_limit, case when v is null then 0 else cast(greatest(floor(v - 50), 0) as bigint) end page_offset from v""",
    "event_json_path_index": """select cast(json_extract_string(props, '$.k') as int) k, min(event_id) first_event, count(*) events from events where json_extract_string(props, '$.k') is not null group by 1""",
    "event_decoded_props": """select event_id, case when event_id % 7 <> 0 then cast(json_extract_string(props, '$.k') as int) end k,
case when event_id % 7 <> 0 then replace(props, ' ', '') else '{}' end metadata from events""",
    "customer_ranked_list": "select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) place from customer",
    "customer_newest_orders": "select c_custkey, c_name, max(o_orderdate) newest, count(*) orders from customer join orders on o_custkey = c_custkey group by 1, 2",
    "lineitem_checked_insert": """with l as (select l_orderkey || ':' || l_linenumber id, l_linenumber n, l_orderkey + case when l_linenumber = 7 then 10000000 else 0 end o, l_partkey - case when l_quantity > 49 then 10000000 else 0 end p from lineitem),
e as (select distinct l_orderkey || ':' || l_linenumber id from lineitem where l_linenumber = 1),
x as (select id, case when id in (select id from e) then 'exists' when o not in (select o_orderkey from orders) then 'no l_orderkey' when p not in (select p_partkey from part) then 'no l_partkey' else 'inserted' end outcome from l)
select outcome, count(*) as "lines", count(distinct id) ids from x group by outcome""",
    "orders_guarded_update": """with u as (select o_orderkey + case when o_orderkey % 10 = 3 then 100000000 else 0 end k, case when o_orderkey % 4 = 0 then 'P' when o_orderkey % 4 = 1 then o_orderstatus end e from orders),
x as (select k, o.o_orderkey is not null held, o.o_orderstatus stored, e from u left join orders o on o.o_orderkey = k)
select k o_orderkey, case when not held then 'missing' when e is null or e = stored then 'updated' else 'conflict' end outcome, case when held and (e is null or e = stored) then 'X' else stored end o_orderstatus from x""",
    "orders_partial_update": """select o_orderkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end o_orderstatus, case when o_orderkey % 15 = 0 then 'NEW' else o_orderpriority end o_orderpriority from orders""",
    "customer_upsert": """with i as (select o_custkey + o_orderkey % 2 * 1000000 k, max(case when o_totalprice > 300000 then 'LARGE' else 'SMALL' end) s from orders group by 1)
select coalesce(k, c_custkey) c_custkey, coalesce(s, c_mktsegment) c_mktsegment, case when c_custkey is null then 'inserted' when k is null then 'kept' when s is not distinct from c_mktsegment then 'same' else 'updated' end as "change"
from customer full join i on k = c_custkey""",
    "part_insert_or_ignore": """select p_partkey, p_brand from part union all select distinct l_partkey * 2, 'new' from lineitem where l_partkey * 2 not in (select p_partkey from part)""",
    "event_insert_below": """select event_id, cast(h as int) held, h < 5 inserted from (select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 h from events)""",
    "orders_merged_records": f"""with {_VERSIONS} select b.o_orderkey,
case when i.o_orderkey is not null and (i.o_orderstatus is distinct from b.o_orderstatus or i.o_orderpriority is distinct from b.o_orderpriority) then i.o_orderstatus else c.o_orderstatus end o_orderstatus,
case when i.o_orderkey is not null and (i.o_orderstatus is distinct from b.o_orderstatus or i.o_orderpriority is distinct from b.o_orderpriority) then i.o_orderpriority else c.o_orderpriority end o_orderpriority
from base b left join cur c using (o_orderkey) left join inc i using (o_orderkey)
where not (i.o_orderkey is null and c.o_orderkey is not null and c.o_orderstatus is not distinct from b.o_orderstatus and c.o_orderpriority is not distinct from b.o_orderpriority)
and (c.o_orderkey is not null or (i.o_orderkey is not null and (i.o_orderstatus is distinct from b.o_orderstatus or i.o_orderpriority is distinct from b.o_orderpriority)))""",
    "orders_patch": """with p as (select case when o_orderkey % 9 = 0 then o_orderkey + 100000000 else o_orderkey end k, case when o_orderkey % 2 = 0 then 'set' when o_orderkey % 5 = 0 then 'add' else 'remove' end op from orders where o_orderkey % 3 = 0),
x as (select coalesce(o_orderkey, k) k, o_orderkey is not null has, o_orderstatus s, op from orders full join p on k = o_orderkey),
y as (select *, case when op is null then 'kept' when op = 'add' and has then 'conflict' when op = 'add' then 'added' when not has then 'conflict' when op = 'remove' then 'removed' else 'changed' end status from x)
select k o_orderkey, status, case when status in ('added', 'changed') then 'X' when status <> 'removed' then s end o_orderstatus from y""",
    "orders_reconcile": f"""with {_VERSIONS}, scan as (select o_orderkey, o_orderstatus from cur where o_orderkey % 17 <> 0 union all select o_orderkey + 100000000, o_orderstatus from base)
select coalesce(b.o_orderkey, s.o_orderkey) o_orderkey, case when b.o_orderkey is null then 'add' when s.o_orderkey is null then 'remove' else 'update' end as "action"
from base b full join scan s on b.o_orderkey = s.o_orderkey where b.o_orderkey is null or s.o_orderkey is null or b.o_orderstatus is distinct from s.o_orderstatus""",
    "orders_import_classes": """with b as (select case when o_orderkey % 7 = 0 then o_orderkey + 100000000 when o_orderkey % 11 = 0 then o_orderkey - 1 else o_orderkey end k, case when o_orderkey % 13 = 0 then -1 else o_custkey end c,
 case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end s, o_orderkey turned from orders),
n as (select *, row_number() over (partition by k order by turned) t from b)
select turned, k o_orderkey, case when t > 1 then 'repeated' when c not in (select c_custkey from customer) then 'missing' when o_orderkey is null then 'new' when s = o_orderstatus then 'identical' else 'conflict' end as "class" from n left join orders on o_orderkey = k""",
    "orders_merged_page": """select o_orderkey, case when o_orderstatus = 'O' then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderstatus from orders where o_totalprice > 100000 or o_orderstatus = 'O' order by 2 desc, 1 limit 100""",
    "event_generation_drop": """select event_id, floor(value) < max(floor(value)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) late from events""",
    "lineitem_stale": """select case when o_orderkey is null or o_orderstatus <> l_linestatus then 'invalidated' else 'accepted' end state, l_linestatus revision, count(*) "lines" from lineitem left join (select * from orders where o_orderkey % 10 <> 0) on o_orderkey = l_orderkey group by 1, 2""",
    "orders_preferred": """select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'P' and o_orderpriority = '1-URGENT') desc, (o_orderstatus = 'P') desc, o_orderdate desc, o_orderkey desc) t from orders) where t = 1""",
    "event_snapshot_bases": """select event_id, case when r > 8 then 'conflict' else 'merge' end outcome from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where event_type = 'purchase'""",
    "event_recents": """with r as (select user_id, event_id, ts from events order by ts desc, event_id desc limit 100) select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) place from r""",
    "orders_eviction": """select o_orderpriority, count(*) evicted, max(o_orderdate) newest_evicted from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) r from orders) where r > 200 group by 1""",
}
