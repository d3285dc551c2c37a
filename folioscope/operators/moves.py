"""Orders of records as the fewest moves from another order, and moves applied to an order."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.shared import cut


#: Moves of a scope up to which their chains are followed by one task; those of others by joins.
FEW_MOVES = 100_000


def _kept(ranks: list[int]) -> np.ndarray:
    """Marks of a longest increasing run, by piles: a rank goes on the first pile whose top is not below it."""
    tops, at = [], []
    before = np.empty(len(ranks), np.int64)
    for k, rank in enumerate(ranks):
        pile = bisect_left(tops, rank)
        before[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(rank)
            at.append(k)
        else:
            tops[pile], at[pile] = rank, k
    out = np.zeros(len(ranks), bool)
    k = at[-1] if at else -1
    while k >= 0:
        out[k] = True
        k = before[k]
    return out


def _whole(batches: Iterator[pa.RecordBatch], told: Callable[[pa.Table, list[int]], pa.Table]) -> Iterator[pa.RecordBatch]:
    """What ``told`` says of rows that stand by ``group``: it is given whole groups, as many as a batch ends, and where each begins and the last one ends."""

    def some(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        group = whole["group"].to_numpy()
        yield from told(whole, [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]).to_batches()

    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch["group"].to_numpy()
        begins = np.flatnonzero(group != group[-1])
        last = int(begins[-1]) + 1 if len(begins) else 0
        if open_ and (last or open_[0]["group"][0].as_py() != group[-1]):
            yield from some([*open_, batch.slice(0, last)])
            open_ = []
        elif last:
            yield from some([batch.slice(0, last)])
        open_.append(batch.slice(last))
    if open_:
        yield from some(open_)


def _chains(keys: list, afters: list) -> tuple[list, list]:
    """For each moved key the anchor that its chain hangs on and how many steps away it is; nothing where it leads in a circle."""
    up, known = dict(zip(keys, afters)), {}
    for key in keys:
        path = []
        while key in up and key not in known:
            path.append(key)
            known[key] = (None, None)  # on the way; what is met again leads in a circle
            key = up[key]
        root, depth = known[key] if key in known else (key, 0)
        for own in reversed(path):
            depth = None if depth is None else depth + 1
            known[own] = root, depth
    return [known[k][0] for k in keys], [known[k][1] for k in keys]


def key_moves(orders: DataFrame, scope: str, key: str, natural: str, target: str) -> DataFrame:
    """(scope, key, after): the fewest single moves, each behind its new predecessor (null: to the front), from the natural to the target order.

    ``orders`` has each key of a scope once, with its places in both orders (any numbers
    that sort). What stands in place at the beginning and the end of a list cannot move
    and is told apart by Spark; a scope without anything else costs nothing more. The
    rest of one scope is read in order by one task, as the piles demand: it holds some 40
    bytes for each key between the first and the last that moved.
    """
    ranked = orders.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(natural).alias("natural"), F.col(target).alias("target")).repartition("scope")
    own = Window.partitionBy("scope")
    ranked = ranked.withColumn("n", F.row_number().over(own.orderBy("natural", "key"))).withColumn("t", F.row_number().over(own.orderBy("target", "key")))
    ranked = ranked.withColumn("after", F.lag("key").over(own.orderBy("t")))
    wrong = F.when(F.col("n") != F.col("t"), F.col("t"))
    span = ranked.withColumn("low", F.min(wrong).over(own)).withColumn("high", F.max(wrong).over(own))
    open_ = span.where("t between low and high").select("scope", "key", "after", "n", "t")

    def told(rows: pa.Table, begins: list[int]) -> pa.Table:
        ranks, moves = rows["n"].to_pylist(), np.empty(len(rows), bool)
        for a, b in zip(begins, begins[1:]):
            moves[a:b] = ~_kept(ranks[a:b])
        return rows.select(["scope", "key", "after"]).filter(pa.array(moves))

    # A number for the scope, so that null scopes are a group too; the rows were dealt by scope before they were ranked.
    grouped = open_.withColumn("group", F.xxhash64("scope")).sortWithinPartitions("scope", "t")
    kinds = {f.name: f.dataType.simpleString() for f in open_.schema.fields}
    out = grouped.mapInArrow(lambda batches: _whole(batches, told), f"scope {kinds['scope']}, key {kinds['key']}, after {kinds['after']}")
    return out.select(F.col("scope").alias(scope), F.col("key").alias(key), "after")


def _followed(follows: DataFrame) -> DataFrame:
    """(scope, key, root, depth) of moves (scope, after, key), scope by scope."""

    def told(rows: pa.Table, begins: list[int]) -> pa.Table:
        keys, afters, roots, depths = rows["key"].to_pylist(), rows["after"].to_pylist(), [], []
        for a, b in zip(begins, begins[1:]):
            root, depth = _chains(keys[a:b], afters[a:b])
            roots += root
            depths += depth
        return rows.select(["scope", "key"]).append_column("root", pa.array(roots, rows.schema.field("after").type)).append_column("depth", pa.array(depths, pa.int64()))

    kinds = {f.name: f.dataType.simpleString() for f in follows.schema.fields}
    grouped = follows.repartition("scope").withColumn("group", F.xxhash64("scope")).sortWithinPartitions("scope", "key")
    return grouped.mapInArrow(lambda batches: _whole(batches, told), f"scope {kinds['scope']}, key {kinds['key']}, root {kinds['after']}, depth long")


def _joined(follows: DataFrame) -> DataFrame:
    """The same by joins that double their reach, whatever the size of a scope."""
    reach = cut(follows.select("scope", "key", F.col("after").alias("root"), F.lit(1).cast("long").alias("depth")))
    longest, bound = reach.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while bound <= longest:
        up = reach.select("scope", F.col("key").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        met = reach.join(up, ["scope", "root"], "left")
        further = F.col("more").isNotNull()
        reach = cut(met.select("scope", "key", F.when(further, F.col("above")).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        bound *= 2
    return reach


def moved(orders: DataFrame, moves: DataFrame, scope: str, key: str, natural: str, few: int = FEW_MOVES) -> DataFrame:
    """(scope, key, place): the natural order with moves (scope, key, after) applied.

    Moved keys follow their anchors, which may have moved too; an unmoved key keeps its
    place among the unmoved. Moves of keys that are not there are passed over; keys whose
    anchors are missing, or lead in a circle, come last in natural order. Of several moves
    behind one anchor the last by key counts, the others come last as well.

    Rows without a scope take no part; a natural place is not null. A chain of moves hangs on an unmoved key (or the front); chains are followed
    by one task in scopes of ``few`` moves or less, and by joins that double their reach
    in others, none longer than the moves of its scope.
    """
    own = orders.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(natural).alias("natural"))
    steps = cut(moves.select(F.col(scope).alias("scope"), F.col(key).alias("key"), "after").join(own, ["scope", "key"]))
    follows = steps.groupBy("scope", "after").agg(F.max("key").alias("key"))
    # (root, depth) of each moved key: its anchor and how many steps away it is.
    large = cut(follows.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > few).select("scope"))
    if large.isEmpty():
        reach = _followed(follows)
    else:
        reach = _followed(follows.join(F.broadcast(large), "scope", "left_anti")).unionByName(_joined(follows.join(F.broadcast(large), "scope", "left_semi")))
    gone = steps.select("scope", "key", F.lit(True).alias("gone")).distinct()
    marked = own.join(gone, ["scope", "key"], "left").join(reach, ["scope", "key"], "left")
    anchors = own.join(gone, ["scope", "key"], "left_anti").select("scope", F.col("key").alias("root"), F.col("natural").alias("held"))
    marked = marked.join(anchors, ["scope", "root"], "left")
    front = F.col("depth").isNotNull() & F.col("root").isNull()
    part = F.when(F.col("gone").isNull(), 1).when(front, 0).when(F.col("held").isNotNull(), 1).otherwise(2)
    found = marked.select("scope", "key", part.alias("part"), F.when(front, None).otherwise(F.coalesce("held", "natural")).alias("natural"), F.when(part < 2, F.coalesce("depth", F.lit(0))).alias("depth"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("part", "natural", "depth", "key"))
    return found.select(F.col("scope").alias(scope), F.col("key").alias(key), place.alias("place"))
