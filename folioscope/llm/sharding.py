"""Sharding by histogram sort: shards of nearly equal bytes, cut from one global order.

The order is (hash of the text, hash of the id, hash of the row's place), so that
equal texts stand together and only a cut inside a large group parts them; the
place parts rows that repeat text and id. Every round counts the exact bytes that
lie below evenly spaced probes inside the interval in which each splitter is still
sought; the interval that holds the target becomes the next round's, until the
bytes at its edge are within the tolerance. The keys are held in a checkpoint, as
places would not be the same in another attempt. Rows move once, in the final
exchange that numbers them.

Null texts have no bytes and size 1; null ids are a group of their own. An empty
table gives no rows. Other columns pass through when the caller joins by key; the
operator itself keeps all columns of ``df``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh, named

PROBES = 256
TOP = 1 << 63
#: Rows that one task of the final exchange numbers.
ROWS_PER_RANGE = 200_000


def _positive_hash(column: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 1)


class _Search:
    """One splitter: target bytes, the interval still open, and the bytes known to lie below it."""

    def __init__(self, target: float):
        self.target, self.low, self.high, self.below = target, 0, TOP, 0
        self.group: tuple[int, ...] = ()  # leading keys inside which the next one is probed
        self.done = False

    def splitter(self) -> tuple[int, ...]:
        """The least key that is not below."""
        if self.low < TOP:
            return (*self.group, self.low)
        return (*self.group[:-1], self.group[-1] + 1) if self.group else (TOP,)


def _narrow(rows: DataFrame, keys: list[str], size: str, open_: list[_Search], tolerance: float) -> None:
    """One round: exact bytes between the probes of all open splitters, in a single aggregation of bounded size."""
    slots = []
    for s in open_:
        step = -(-(s.high - s.low) // PROBES)
        of = named(keys[len(s.group)])
        inside = (of >= F.lit(s.low)) & (of <= F.lit(s.high - 1))
        for name, value in zip(keys, s.group):
            inside &= named(name) == F.lit(value)
        slots.append(F.when(inside, (of - F.lit(s.low)) - F.pmod(of - F.lit(s.low), F.lit(step))).alias(f"s{len(slots)}"))
    # Splitters with equal intervals need one count only.
    asked = {(s.group, s.low, s.high): k for k, s in reversed(list(enumerate(open_)))}
    probed = F.array(*(F.struct(F.lit(k).alias("k"), slots[k].alias("at")) for k in asked.values()))
    found = rows.select(F.explode(F.filter(probed, lambda x: x["at"].isNotNull())).alias("x"), named(size).alias("size"))
    counted: dict[int, list[tuple[int, int]]] = {}
    for k, at, total in found.groupBy("x.k", "x.at").agg(F.sum("size")).collect():  # at most PROBES a splitter
        counted.setdefault(k, []).append((at, total))
    for s in open_:
        low, step, below = s.low, -(-(s.high - s.low) // PROBES), s.below
        for at, total in sorted(counted.get(asked[s.group, s.low, s.high], [])):
            if below + total >= s.target:
                break
            below += total
        else:
            at, total = s.high - low, 0
        # The cut is before or after the range [at, at + step), or inside it.
        if s.target - below <= tolerance:
            s.low, s.below, s.done = low + at, below, True
        elif below + total - s.target <= tolerance:
            s.low, s.below, s.done = min(low + at + step, s.high), below + total, True
        elif step > 1:
            s.low, s.high, s.below = low + at, min(low + at + step, s.high), below
        elif len(s.group) + 1 < len(keys):
            s.group, s.low, s.high, s.below = (*s.group, low + at), 0, TOP, below
        else:  # one row: it cannot be parted
            near = s.target - below <= below + total - s.target
            s.low, s.below, s.done = low + at + (0 if near else 1), below + (0 if near else total), True


def _narrowed(rows: DataFrame, keys: list[str], size: str, searches: list[_Search], tolerance: float) -> list[tuple[int, ...]]:
    while open_ := [s for s in searches if not s.done]:
        _narrow(rows, keys, size, open_, tolerance)
    return sorted(s.splitter() for s in searches)


def _not_below(keys: list[str], splitter: tuple[int, ...]) -> Column:
    name, value = named(keys[0]), splitter[0]
    if value >= TOP:
        return F.lit(False)
    if len(splitter) == 1:
        return name >= F.lit(value)
    return (name > F.lit(value)) | ((name == F.lit(value)) & _not_below(keys[1:], splitter[1:]))


def assign_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (or the columns ``keep`` of them) with size, shard and slot.

    ``size`` is the UTF-8 bytes of the text plus 1, ``slot`` a gapless number from 0
    within the shard. Shard sizes differ from the mean by at most ``tolerance`` of it
    and one row.
    """
    kept = df.columns if keep is None else keep
    size, shard, slot, first, second, third, range_ = fresh(df, "size", "shard", "slot", "shard_k1", "shard_k2", "shard_k3", "shard_range")
    keys = df.select(
        *map(named, kept),
        (F.coalesce(F.octet_length(named(text_col)), F.lit(0)) + 1).cast("long").alias(size),
        _positive_hash(named(text_col)).alias(first),
        _positive_hash(named(id_col)).alias(second),
        _positive_hash(F.monotonically_increasing_id()).alias(third),
    )
    keys = cut(keys)
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum(named(size)), F.lit(0))).first()
    searches = [_Search(total * k / shards) for k in range(1, shards)]
    own = [first, second, third]
    splitters = _narrowed(keys, own, size, searches, tolerance * total / shards) if rows else []
    at_least = [_not_below(own, x) for x in splitters]
    which = sum((c.cast("int") for c in at_least), F.lit(0))
    # The final exchange: each shard in ranges small enough for a task, dealt by id so that a large group is spread.
    ranges = max(1, -(-rows // (shards * ROWS_PER_RANGE)))
    dealt = keys.withColumn(shard, which).withColumn(range_, F.pmod(F.shiftrightunsigned(named(third), 7), F.lit(ranges)).cast("int"))
    counts = dealt.groupBy(shard, range_).agg(F.count("*").alias("n"))
    starts = counts.select(named(shard).alias("s"), named(range_).alias("r"), (F.sum("n").over(Window.partitionBy(shard).orderBy(range_)) - F.col("n")).alias("start"))
    order = Window.partitionBy(shard, range_).orderBy(first, second, third)
    numbered = dealt.withColumn(slot, F.row_number().over(order).cast("long") - 1)
    joined = numbered.join(F.broadcast(starts) if shards * ranges <= 100_000 else starts, (named(shard) == F.col("s")) & (named(range_) == F.col("r")))
    return joined.select(*map(named, kept), named(size), named(shard), (named(slot) + F.col("start")).alias(slot))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The sharded rows as one folder for each shard, rows in order of their slots within a file."""
    out = assign_shards(df, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
