"""Rules that depend on the order of records: ranks by counts, budgets, and folds along a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Slices in which the values of a group are ranked.
SLICES = 64


def ranked_values(rows: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the values at some ranks (from 1, as a function of the group's size).

    Slices between approximate percentiles are counted first; only those that hold a
    wanted rank are ordered, each by itself, so that no group is gathered.
    """
    known = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("value"))
    cuts = known.groupBy(by).agg(F.percentile_approx("value", [k / SLICES for k in range(1, SLICES)]).alias("cuts"))
    sliced = known.join(cuts, by).select(by, "value", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("slice"))
    counts = sliced.groupBy(by, "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("slice")) - F.col("n")
    counts = counts.select(by, "slice", "n", before.alias("before"), F.sum("n").over(Window.partitionBy(by)).alias("size"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("size")).cast("long").alias("rank")) for name, rank in ranks.items()))
    held = counts.select("*", F.explode(wanted).alias("x")).where("x.rank > before and x.rank <= before + n").select(by, "slice", "x.name", (F.col("x.rank") - F.col("before")).alias("inside"))
    place = F.row_number().over(Window.partitionBy(by, "slice").orderBy("value"))
    near = sliced.join(held.select(by, "slice").distinct(), [by, "slice"]).withColumn("inside", place.cast("long"))
    found = near.join(held, [by, "slice", "inside"])
    return found.groupBy(by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks))


def within_budget(rows: DataFrame, scope: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows of each scope in order while the running cost stays within the budget."""
    spent = F.sum(cost).over(Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], object], result: str, kind: T.DataType, uses: list[str] | None = None) -> DataFrame:
    """``rows`` with what ``step`` says of each, in order along a key: it is given the state of the key and the row (the columns it ``uses``), and may change the state.

    Rows are streamed key by key, so that a long key takes time but no memory; a key that holds
    many rows is followed by one task all the same, as each row depends on those before. Rows
    without a key are a group of their own.
    """
    names = uses or rows.columns
    told = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = object(), {}
        for batch in batches:
            out = []
            for now, *values in zip(*(batch.column(c).to_pylist() for c in (key, *names))):
                if now != own:
                    own, state = now, start()
                out.append(step(state, dict(zip(names, values))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, told)], names=[*batch.schema.names, result])

    schema = T.StructType([*rows.schema.fields, T.StructField(result, kind)])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def throttle(time: str, seconds: float = 30.0) -> Callable[[dict, dict], bool]:
    """A row less than so many seconds after the last kept one of its key is not kept."""

    def step(state: dict, row: dict) -> bool:
        now = row[time].timestamp()
        kept = "last" not in state or now - state["last"] >= seconds
        if kept:
            state["last"] = now
        return kept

    return step


def throttled(rows: DataFrame, key: str, time: str, tie: str, seconds: float = 30.0) -> DataFrame:
    """Rows with ``kept``: see ``throttle``."""
    return folded(rows, key, [time, tie], dict, throttle(time, seconds), "kept", T.BooleanType(), uses=[time])


def cool_down(time: str, limited: str, retry: str, least: float = 20.0) -> Callable[[dict, dict], bool]:
    """After a limited row that was asked its key rests for what that row asks, at least so many seconds; meanwhile nothing is asked."""

    def step(state: dict, row: dict) -> bool:
        now = row[time].timestamp()
        asked = now >= state.get("until", now)
        if asked and row[limited]:
            state["until"] = now + max(least, row[retry] or 0.0)
        return asked

    return step


def cooled_down(rows: DataFrame, key: str, time: str, tie: str, limited: str, retry: str, least: float = 20.0) -> DataFrame:
    """Rows with ``asked``: see ``cool_down``."""
    return folded(rows, key, [time, tie], dict, cool_down(time, limited, retry, least), "asked", T.BooleanType(), uses=[time, limited, retry])


# How often a session's token is renewed at most.
MOST_RENEWALS = 4096


def renewal(time: str, kind: str, token: str, replacement: str, expires: str) -> Callable[[dict, dict], str]:
    """What becomes of a session's events: ``open`` and ``renew`` bring a token, ``revoke`` ends the session.

    Renewing with the current token replaces it. A token that was replaced already tells of
    a thief: ``reuse`` ends the session, and all its tokens. Any other token, an expired or
    ended session, and a session renewed too often are ``invalid``. The state holds the
    tokens that a session replaced, a bounded number.
    """

    def step(state: dict, row: dict) -> str:
        now = row[time].timestamp()
        if row[kind] == "open":
            if state:
                return "invalid"
            ends = row[expires]
            state.update(token=row[token], used=[], until=ends.timestamp() if ends is not None else None)
            return "opened"
        if row[kind] == "revoke":
            over = not state or state["token"] is None
            if state:
                state["token"] = None
            return "invalid" if over else "revoked"
        live = bool(state) and state["token"] is not None and (state["until"] is None or state["until"] > now)
        if live and row[token] in state["used"]:
            state["token"] = None
            return "reuse"
        if not live or row[token] != state["token"] or row[replacement] is None or len(state["used"]) >= MOST_RENEWALS:
            return "invalid"
        state["used"].append(row[token])
        state["token"] = row[replacement]
        return "renewed"

    return step


def renewed(rows: DataFrame, session: str, time: str, tie: str, kind: str, token: str, replacement: str, expires: str) -> DataFrame:
    """Rows with ``outcome``: see ``renewal``."""
    step = renewal(time, kind, token, replacement, expires)
    return folded(rows, session, [time, tie], dict, step, "outcome", T.StringType(), uses=[time, kind, token, replacement, expires])


def remembering(kind: str, record: str) -> Callable[[dict, dict], str]:
    """The state of memories that were derived alike: what an event makes of its record, or why nothing.

    ``propose`` makes a pending record unless one like it was forgotten (``suppressed``),
    ``create`` an accepted one; ``accept`` and ``reject`` decide a pending one, ``forget``
    rejects an open one and keeps new ones from being proposed, ``invalidate`` ends any
    that is not. Others are ``refused``.
    """

    def step(state: dict, row: dict) -> str:
        records, what, own = state.setdefault("records", {}), row[kind], str(row[record])
        now = records.get(own)
        if what in ("propose", "create"):
            if now is not None:
                return "refused"
            if what == "propose" and state.get("forgotten"):
                return "suppressed"
            records[own] = "pending" if what == "propose" else "accepted"
        elif now is None or (what in ("accept", "reject") and now != "pending") or (what == "invalidate" and now == "invalidated"):
            return "refused"
        elif what == "forget":
            state["forgotten"] = True
            records[own] = "rejected" if now in ("pending", "accepted") else now
        else:
            records[own] = {"accept": "accepted", "reject": "rejected", "invalidate": "invalidated"}.get(what, now)
        return records[own]

    return step


def remembered(rows: DataFrame, derivation: str, order: list[str], kind: str, record: str) -> DataFrame:
    """Rows with ``outcome``: see ``remembering``; ``derivation`` tells what a memory was derived from, and its scope."""
    return folded(rows, derivation, order, dict, remembering(kind, record), "outcome", T.StringType(), uses=[kind, record])


def pruned(snapshots: DataFrame, conflicts: DataFrame, time: str, revision: str, now: Column, days: int = 30) -> DataFrame:
    """Snapshots that are kept: younger than so many days, or of a revision that an unresolved conflict (revision, status) needs."""
    needed = conflicts.where("status = 'unresolved'").select(F.col("revision").alias("needed")).where("needed is not null").distinct()
    out = snapshots.join(needed, F.col(revision) == F.col("needed"), "left")
    return out.where((F.col(time) >= now - F.make_interval(days=F.lit(days))) | F.col("needed").isNotNull()).select(*snapshots.columns)


def budget_ledger(rows: DataFrame, key: str, order: list[str], kind: str, amount: str, cap: float) -> DataFrame:
    """Rows with ``verdict``: a reservation beyond the cap is refused, a commit turns reserved into spent, a release gives back."""

    def step(state: dict, row: dict) -> str:
        what, x = row[kind], row[amount] or 0.0
        if what == "reserve":
            if state["spent"] + state["reserved"] + x > cap:
                return "refused"
            state["reserved"] += x
            return "reserved"
        taken = min(x, state["reserved"])
        state["reserved"] -= taken
        if what == "commit":
            state["spent"] += taken
            return "committed"
        return "released"

    return folded(rows, key, order, lambda: {"spent": 0.0, "reserved": 0.0}, step, "verdict", T.StringType(), uses=[kind, amount])


def lifecycle(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Rows with the ``state`` of their record after them: proposals are pending until accepted, rejected or invalidated; a rejection suppresses later proposals."""

    def step(state: dict, row: dict) -> str:
        now, what = state.get("is", "none"), row[kind]
        if what == "propose" and now in ("none", "invalidated"):
            now = "pending"
        elif what == "accept" and now == "pending":
            now = "accepted"
        elif what == "reject" and now in ("pending", "accepted"):
            now = "rejected"
        elif what == "invalidate" and now in ("pending", "accepted"):
            now = "invalidated"
        state["is"] = now
        return now

    return folded(rows, key, order, dict, step, "state", T.StringType(), uses=[kind])


def greedy_selection(rows: DataFrame, scope: str, score: str, tie: str, cost: str, entries: int = 8, budget: int = 1000, most: int = 64) -> DataFrame:
    """(scope, chosen): of the ``most`` best candidates those that fit: one that is too large is passed over, and the next tried."""
    best = Window.partitionBy(scope).orderBy(F.desc(score), tie)
    top = rows.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= most)
    lists = top.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("turn", F.col(tie).alias("id"), F.col(cost).cast("long").alias("cost")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<bigint>").alias("chosen"))

    def take(state: Column, x: Column) -> Column:
        fits = (F.size(state["chosen"]) < entries) & (state["spent"] + x["cost"] <= budget)
        taken = F.struct((state["spent"] + x["cost"]).alias("spent"), F.concat(state["chosen"], F.array(x["id"].cast("long"))).alias("chosen"))
        return F.when(fits, taken).otherwise(state)

    return lists.select(scope, F.aggregate("all", start, take, lambda s: s["chosen"]).alias("chosen"))
