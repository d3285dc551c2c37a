"""Order and grouping of what stands on a page; a page is a small group of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.ordered import folded

# A column is at most this share of the page's width, a spanning line at least that one.
COLUMN_WIDTH, SPANNING = 0.5, 0.72
# Share of an area that makes a block part of a visual, and of heights for items of one line.
NESTED, SAME_LINE = 0.5, 0.5


def lines_of_items(items: DataFrame, page: str) -> DataFrame:
    """``items`` (x, y, width, height, ord) with their ``line``: an item joins the first line whose last item it follows at nearly the same height."""

    def step(ends: dict, r: dict) -> int:
        middle = r["y"] + r["height"] / 2
        for k, (right, own, height) in ends.items():
            if abs(middle - own) <= SAME_LINE * min(r["height"], height) and r["x"] >= right - 1:
                break
        else:
            k = len(ends)
        ends[k] = (r["x"] + r["width"], middle, r["height"])
        return k

    return folded(items, page, ["ord"], dict, step, "line", T.IntegerType())


def reading_order(lines: DataFrame, page: list[str], width: float) -> DataFrame:
    """``lines`` (x, y, width) with their place: bands between spanning lines from top to bottom, in each the left column before the right one."""
    spanning = (F.col("width") >= SPANNING * width).cast("int")
    down = Window.partitionBy(*page).orderBy("y", "x")
    # A spanning line opens a band of its own and the one below it.
    band = 2 * F.sum(spanning).over(down) - spanning
    column = F.when(spanning == 1, 0).when(F.col("x") >= COLUMN_WIDTH * width, 1).otherwise(0)
    banded = lines.withColumn("band", band).withColumn("column", column)
    return banded.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("band", "column", "y", "x")))


def heading_parents(headings: DataFrame, page: str, order: str, level: str) -> DataFrame:
    """``headings`` with the place of their parent: the nearest one before that is still open and less deep."""

    def step(state: dict, r: dict) -> int | None:
        open_ = state.setdefault("open", [])
        while open_ and open_[-1][1] >= r[level]:
            open_.pop()
        parent = open_[-1][0] if open_ else None
        open_.append((r[order], r[level]))
        return parent

    return folded(headings, page, [order], dict, step, "parent", T.LongType())


def nested_blocks(blocks: DataFrame, visuals: DataFrame, page: str, key: str) -> DataFrame:
    """Blocks of which a visual of their page covers half or more: they belong to it and not to the text."""
    v = visuals.select(page, *(F.col(c).alias(f"v_{c}") for c in ("x", "y", "r", "b")))
    wide = F.least("r", "v_r") - F.greatest("x", "v_x")
    high = F.least("b", "v_b") - F.greatest("y", "v_y")
    covered = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    area = (F.col("r") - F.col("x")) * (F.col("b") - F.col("y"))
    return blocks.join(v, page).where((area > 0) & (covered >= NESTED * area)).select(page, key).distinct()


def nearest_captions(captions: DataFrame, visuals: DataFrame, page: str) -> DataFrame:
    """Each caption's visual: the one at the least vertical distance, then the leftmost; (page, caption, visual, distance)."""
    joined = captions.select(page, "caption", F.col("y").alias("cy")).join(visuals.select(page, "visual", "y", "b", "x"), page)
    distance = F.greatest(F.col("y") - F.col("cy"), F.col("cy") - F.col("b"), F.lit(0.0))
    order = Window.partitionBy(page, "caption").orderBy("distance", "x", "visual")
    return joined.withColumn("distance", distance).withColumn("turn", F.row_number().over(order)).where("turn = 1").select(page, "caption", "visual", "distance")


def open_sections(headings: DataFrame, page: str, order: str, level: str, last: int) -> DataFrame:
    """``headings`` with the place at which their section ends: before the next one that is no deeper, or at ``last``."""
    own = Window.partitionBy(page).orderBy(order, level)
    behind = F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).alias("l"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    again = F.lag(order).over(own).eqNullSafe(F.col(order)) & F.lag(level).over(own).eqNullSafe(F.col(level)) & (F.row_number().over(own) > 1)
    # One sort of a page's headings; those that are repeated stand together.
    told = headings.select(page, order, level).select("*", behind.alias("_behind"), again.alias("_again")).where(~F.col("_again"))
    ends = F.array_min(F.transform(F.filter("_behind", lambda x: (x["o"] > F.col(order)) & (x["l"] <= F.col(level))), lambda x: x["o"]))
    return told.select(page, order, level, F.coalesce(F.when(F.col(page).isNotNull(), ends) - 1, F.lit(last)).alias("ends"))
