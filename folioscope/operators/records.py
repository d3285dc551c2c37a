"""Keyed record sets: diff, three-way merge, upsert, fusion of rankings, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(base: DataFrame, changed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed_fields): added, removed or changed records; equal ones are left out."""
    a, b = base.alias("a"), changed.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    moved = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(moved) > 0, "changed")
    out = joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), change.alias("change"), F.when(change == "changed", F.array_join(moved, ",")).otherwise("").alias("changed_fields"))
    return out.where("change is not null")


def merged_field(base: Column, current: Column, incoming: Column) -> tuple[Column, Column]:
    """Three-way merge of a field: its value, and whether both sides changed it differently (then the current value stays)."""
    value = F.when(incoming.eqNullSafe(base), current).when(current.eqNullSafe(base), incoming).otherwise(current)
    conflict = ~incoming.eqNullSafe(base) & ~current.eqNullSafe(base) & ~current.eqNullSafe(incoming)
    return value, conflict


def three_way_merge(base: DataFrame, current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records of the merge with their conflicting fields. A record that one side deleted goes if the other left it as it was."""
    sides = {n: d.select(F.col(key), F.struct(*fields).alias(n)) for n, d in (("base", base), ("current", current), ("incoming", incoming))}
    joined = sides["base"].join(sides["current"], key, "full").join(sides["incoming"], key, "full")
    b, c, i = F.col("base"), F.col("current"), F.col("incoming")
    gone = b.isNotNull() & ((c.isNull() & (i.isNull() | i.eqNullSafe(b))) | (i.isNull() & c.eqNullSafe(b)))
    joined = joined.where(~gone)
    parts = {f: merged_field(b[f], F.when(c.isNull(), i[f]).otherwise(c[f]), F.when(i.isNull(), c[f]).otherwise(i[f])) for f in fields}
    conflicts = F.array_join(F.array_compact(F.array(*(F.when(conflict, F.lit(f)) for f, (_, conflict) in parts.items()))), ",")
    return joined.select(key, *(v.alias(f) for f, (v, _) in parts.items()), conflicts.alias("conflicts"))


def fused_ranks(lists: list[tuple[DataFrame, float]], key: str, shift: int = 8) -> DataFrame:
    """Weighted reciprocal rank fusion of (key, position) lists, positions from 0."""
    every = None
    for ranks, weight in lists:
        one = ranks.select(key, (F.lit(weight) / (shift + F.col("position"))).alias("part"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.round(F.sum("part"), 9).alias("fused"), F.count("*").alias("lists"))


def newest(rows: DataFrame, scope: str, time: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each scope; Spark ranks partially before the exchange."""
    order = Window.partitionBy(scope).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def rate_limited(rows: DataFrame, client: str, time: str, tie: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests with their fixed window, their number in it and whether the limit still allows them."""
    now = F.unix_seconds(F.col(time).cast("timestamp"))
    start = now - F.pmod(now, F.lit(seconds))
    numbered = rows.withColumn("window_start", start)
    order = Window.partitionBy(client, "window_start").orderBy(time, tie)
    return numbered.withColumn("request_count", F.row_number().over(order)).withColumn("allowed", F.col("request_count") <= limit)


def sessions(rows: DataFrame, client: str, time: str, tie: str, gap: int) -> DataFrame:
    """Runs of a client's rows without a gap of more than so many seconds."""
    order = Window.partitionBy(client).orderBy(time, tie)
    fresh = (F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(F.col(time).cast("timestamp")).over(order))) > gap
    marked = rows.withColumn("session", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    return marked.groupBy(client, "session").agg(F.min(time).alias("begins"), F.max(time).alias("ends"), F.count("*").alias("events"))


def extrema(rows: DataFrame, by: str, value: str, label: str) -> DataFrame:
    """Largest and smallest value of groups with two or more, with the label of each; the first label wins ties."""
    known = rows.where(F.col(value).isNotNull())
    out = known.groupBy(by).agg(
        F.count("*").alias("values"), F.max(value).alias("largest"), F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("largest_at"),
        F.min(value).alias("smallest"), F.min_by(label, F.struct(value, label)).alias("smallest_at"),
    )
    return out.where("values >= 2")
