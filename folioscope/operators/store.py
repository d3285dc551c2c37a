"""Reads and writes of record tables: lookups, pages, inserts, updates, patches, imports, retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows on a page unless asked otherwise, and at most.
PAGE_ROWS, MOST_ROWS = 50, 100
#: Slices in which a table is ranked.
RANK_SLICES = 64


def lookup(asked: DataFrame, rows: DataFrame, key: str, row_key: str, fields: list[str]) -> DataFrame:
    """Each asked key once, with the fields of its row, and whether there is one."""
    found = rows.select(F.col(row_key).alias(key), *fields, F.lit(True).alias("found"))
    return asked.select(key).where(F.col(key).isNotNull()).distinct().join(found, key, "left").fillna({"found": False})


def clamped_limit(wanted: Column) -> Column:
    """A page size from 1 to the most; whole, and the default where it is unknown or not a number."""
    known = F.when(wanted.isNull() | F.isnan(wanted), F.lit(float(PAGE_ROWS))).otherwise(wanted)
    return F.least(F.greatest(F.floor(known), F.lit(1)), F.lit(MOST_ROWS)).cast("int")


def clamped_offset(wanted: Column) -> Column:
    known = F.when(wanted.isNull() | F.isnan(wanted), F.lit(0.0)).otherwise(wanted)
    return F.greatest(F.floor(known), F.lit(0)).cast("long")


def filtered(rows: DataFrame, equal: Mapping[str, object | None]) -> DataFrame:
    """Rows that agree with every filter that is given; None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def page(rows: DataFrame, order: list[Column], limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """One page of the ordered rows and, in ``has_next``, whether another follows; one row more than the page is read."""
    limit, offset = min(max(limit, 1), MOST_ROWS), max(offset, 0)
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = some.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("has_next", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def ranked(rows: DataFrame, value: str, tie: str, descending: bool = True) -> DataFrame:
    """``rows`` with their place (from 1) in the order of a number and a unique key, numbered in slices that are counted first."""
    sign = -1 if descending else 1
    own = rows.withColumn("rank_by", F.col(value).cast("double") * sign)
    cuts = own.select(F.percentile_approx("rank_by", [k / RANK_SLICES for k in range(1, RANK_SLICES)]).alias("cuts"))
    cut = own.crossJoin(F.broadcast(cuts))  # one row
    sliced = cut.withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("rank_by")))).drop("cuts")
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    before = counts.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))  # RANK_SLICES rows
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("rank_by", tie))
    return sliced.withColumn("inside", inside).join(F.broadcast(before), "slice").withColumn("place", F.col("before") + F.col("inside")).drop("slice", "inside", "before", "rank_by")


def checked_insert(rows: DataFrame, key: str, existing: DataFrame, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``rows`` with their ``outcome``: inserted, a key that exists, or a reference (column, table, its key) without a row."""
    taken = existing.select(F.col(key).alias("taken")).distinct()
    out = rows.join(taken, F.col(key) == F.col("taken"), "left")
    outcome = F.when(F.col("taken").isNotNull(), "exists")
    for k, (column, target, target_key) in enumerate(references):
        known = target.select(F.col(target_key).alias(f"known_{k}")).distinct()
        out = out.join(known, F.col(column) == F.col(f"known_{k}"), "left")
        outcome = outcome.when(F.col(f"known_{k}").isNull(), f"no {column}")
    return out.select(*rows.columns, outcome.otherwise("inserted").alias("outcome"))


def guarded_update(rows: DataFrame, updates: DataFrame, key: str, field: str) -> DataFrame:
    """Updates (key, expected, value) of one field: applied where the field still is as expected, else a conflict; ``missing`` without a row."""
    joined = updates.join(rows.select(key, F.col(field).alias("stored"), F.lit(True).alias("held")), key, "left")
    outcome = F.when(F.col("held").isNull(), "missing").when(F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("stored")), "updated").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"), F.when(outcome == "updated", F.col("value")).otherwise(F.col("stored")).alias(field))


def partial_update(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the fields that a change gives; what it leaves out (null) stays."""
    named = changes.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    return rows.join(named, key, "left").select(key, *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))


def upserted(rows: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The table after an insert that updates on conflict, with what happened to each row."""
    both = rows.select(key, F.struct(*fields).alias("old")).join(incoming.select(key, F.struct(*fields).alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("updated")
    return both.select(key, *(F.when(F.col("new").isNull(), F.col("old")[f]).otherwise(F.col("new")[f]).alias(f) for f in fields), change.alias("change"))


def inserted_or_ignored(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after an insert that leaves existing keys alone."""
    return rows.unionByName(incoming.join(rows.select(key), key, "left_anti"))


def inserted_below(requests: DataFrame, scope: str, order: list[str], most: int) -> DataFrame:
    """Requests in order, with whether each is let in: while its scope holds fewer than ``most``."""
    held = F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1
    return requests.withColumn("held", held).withColumn("inserted", F.col("held") < most)


def merged_records(base: DataFrame, current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-way merge by whole records: a changed incoming one wins; one that is gone there goes if the current one is as it was."""
    sides = [d.select(key, F.struct(*fields).alias(n)) for n, d in (("b", base), ("c", current), ("i", incoming))]
    joined = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    b, c, i = F.col("b"), F.col("c"), F.col("i")
    deleted = b.isNotNull() & i.isNull() & c.eqNullSafe(b)
    changed = i.isNotNull() & ~i.eqNullSafe(b)
    value = F.when(changed, i).when(c.isNotNull(), c)
    return joined.where(~deleted & value.isNotNull()).select(key, *(value[f].alias(f) for f in fields))


def patched(base: DataFrame, patch: DataFrame, key: str, field: str) -> DataFrame:
    """``base`` after a patch of operations (key, op, value): set and remove; a record that the base lacks makes a conflict, an add of one it has too."""
    held = base.select(key, F.col(field).alias("stored"), F.lit(True).alias("held"))
    joined = held.join(patch.select(key, "op", "value"), key, "full")
    has, op = F.col("held").isNotNull(), F.col("op")
    status = (
        F.when(op.isNull(), "kept")
        .when((op == "add") & has, "conflict").when(op == "add", "added")
        .when(~has, "conflict").when(op == "remove", "removed").otherwise("changed")
    )
    value = F.when(status.isin("added", "changed"), F.col("value")).when(status != "removed", F.col("stored"))
    return joined.select(key, status.alias("status"), value.alias(field))


def reconciled(index: DataFrame, scan: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, action): what a scan asks of an index: add, update or remove; equal revisions ask for nothing."""
    joined = index.select(key, F.col(revision).alias("old"), F.lit(1).alias("a")).join(scan.select(key, F.col(revision).alias("new"), F.lit(1).alias("b")), key, "full")
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return joined.select(key, action.alias("action")).where("action is not null")


def classified_import(batch: DataFrame, existing: DataFrame, key: str, fields: list[str], order: str, needs: tuple[str, DataFrame, str]) -> DataFrame:
    """``batch`` rows with their class: repeated in the batch, missing dependency, new, identical or conflict."""
    column, target, target_key = needs
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    stored = existing.select(F.col(key), F.struct(*fields).alias("stored"))
    known = target.select(F.col(target_key).alias("known")).distinct()
    out = batch.withColumn("turn", place).join(stored, key, "left").join(known, F.col(column) == F.col("known"), "left")
    class_ = (
        F.when(F.col("turn") > 1, "repeated").when(F.col("known").isNull(), "missing").when(F.col("stored").isNull(), "new")
        .when(F.col("stored").eqNullSafe(F.struct(*fields)), "identical").otherwise("conflict")
    )
    return out.select(*batch.columns, class_.alias("class"))


def merged_pages(first: DataFrame, second: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Two ranked sources as one page: of rows with one key the second source's stays."""
    every = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    names = [c for c in first.columns if c != key]
    one = every.groupBy(key).agg(F.max_by(F.struct(*names), "source").alias("row")).select(key, "row.*")
    return one.orderBy(*order).limit(limit)


def current_generation(rows: DataFrame, scope: str, order: list[str], generation: str) -> DataFrame:
    """Rows with whether they are late: of an older generation than one already seen in their scope."""
    seen = F.max(generation).over(Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("late", F.col(generation) < seen)


def stale(rows: DataFrame, key: str, revision: str, current: DataFrame, current_key: str, current_revision: str) -> DataFrame:
    """Rows with their state: invalidated where their source has another revision now or is gone."""
    now = current.select(F.col(current_key).alias("now_key"), F.col(current_revision).alias("now"))
    joined = rows.join(now, F.col(key) == F.col("now_key"), "left")
    state = F.when(F.col("now_key").isNull() | ~F.col(revision).eqNullSafe(F.col("now")), "invalidated").otherwise("accepted")
    return joined.select(*rows.columns, state.alias("state"))


def preferred(rows: DataFrame, scope: str, exact: Column, own: Column, newest: list[Column]) -> DataFrame:
    """One row of each scope: an exact one first, then one's own, then the newest."""
    order = Window.partitionBy(scope).orderBy(exact.desc(), own.desc(), *newest)
    return rows.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def snapshot_window(snapshots: DataFrame, scope: str, order: list[str], asked: DataFrame, base: str, most: int = 8) -> DataFrame:
    """Asked merges with whether their base is still among the last ``most`` snapshots of its scope."""
    last = Window.partitionBy(scope).orderBy(*(F.desc(c) for c in order))
    kept = snapshots.withColumn("age", F.row_number().over(last)).where(F.col("age") <= most).select(F.col(base).alias("kept"))
    joined = asked.join(kept, F.col(base) == F.col("kept"), "left")
    return joined.select(*asked.columns, F.when(F.col("kept").isNull(), "conflict").otherwise("merge").alias("outcome"))
