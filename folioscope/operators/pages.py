"""What stands where on a page: lines of items, boxes in boxes, numbers of equations, and which paragraph a sentence belongs to.

Joins of places go by cells of a grid, so that a box meets what is near it and not its
whole page; what is worked through in order is one page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far items of a line stand apart, in heights and in widths of the page.
LINE_HEIGHTS, LINE_GAP = 0.75, 0.25
# How far right of an equation its number stands, in widths of the page, and what a number looks like.
NUMBER_GAP, EQUATION_NUMBER = 0.25, r"^\([0-9]+\)$"
# Letters of a sentence's opening, the least that tell it, and letters of a probe.
OPENING, LEAST_LETTERS, PROBE = 24, 10, 14


def source_lines(items: DataFrame, page: list[str], item: str, width: float) -> tuple[DataFrame, DataFrame]:
    """``items`` (x, y, width, height) with their ``line``, and the lines (line, items, x, y, width, height) of each page.

    From top to bottom and left to right, an item goes on with the line of the one before
    if it stands at nearly the same height and not too far to the right; the bounds of a
    line are those of all its items.
    """
    down = Window.partitionBy(*page).orderBy("y", "x", item)
    before = F.lag(F.struct("x", "y", "width", "height")).over(down)
    rows = items.withColumn("_before", before)
    b = F.col("_before")
    near = F.abs(F.col("y") - b["y"]) <= F.greatest(F.col("height"), b["height"]) * LINE_HEIGHTS
    same = near & (F.greatest(F.lit(0.0), F.col("x") - (b["x"] + b["width"])) <= width * LINE_GAP)
    opens = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("line", (F.sum(opens).over(down) - 1).cast("int")).drop("_before")
    edges = rows.groupBy(*page, "line").agg(F.count("*").alias("items"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_right"), F.max(F.col("y") + F.col("height")).alias("_bottom"))
    lines = edges.select(*page, "line", "items", "x", "y", (F.col("_right") - F.col("x")).alias("width"), (F.col("_bottom") - F.col("y")).alias("height"))
    return rows, lines


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def inside(boxes: DataFrame, containers: DataFrame, page: str, cell: float = 100.0) -> DataFrame:
    """(page, container, box): boxes (page, box, x, y, width, height) whose middle is in a container (page, container, x, y, width, height) of their page, edges included.

    A middle is in one cell of a grid; a container is told to each cell that it covers.
    """
    middle = boxes.select(page, "box", (F.col("x") + F.col("width") / 2).alias("mx"), (F.col("y") + F.col("height") / 2).alias("my"))
    middle = middle.withColumns({"cx": F.floor(F.col("mx") / cell), "cy": F.floor(F.col("my") / cell)})
    own = containers.where("width >= 0 and height >= 0").withColumn("cx", F.explode(_cells(F.col("x"), F.col("x") + F.col("width"), cell)))
    own = own.withColumn("cy", F.explode(_cells(F.col("y"), F.col("y") + F.col("height"), cell)))
    met = middle.join(own, [page, "cx", "cy"]).where("mx between x and x + width and my between y and y + height")
    return met.select(page, "container", "box")


def equation_numbers(equations: DataFrame, others: DataFrame, page: str, width: float, cell: float = 50.0) -> DataFrame:
    """(page, equation, number): the number ``(3)`` among other blocks (page, content, x, y, height) that stands nearest to the right of an equation (page, equation, x, y, width, height).

    Its middle is no further up or down than the equation is high, its left edge within a
    quarter of the page; of equals the first text counts. Without one there is no row.
    """
    bare = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    numbers = others.select(page, bare.alias("number"), F.col("x").alias("nx"), (F.col("y") + F.col("height") / 2).alias("ny")).where(F.col("number").rlike(EQUATION_NUMBER))
    numbers = numbers.withColumn("row", F.floor(F.col("ny") / cell))
    own = equations.select(page, "equation", (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("height") / 2).alias("my"), "height").where("height >= 0")
    own = own.withColumn("row", F.explode(_cells(F.col("my") - F.col("height"), F.col("my") + F.col("height"), cell)))
    near = own.join(numbers, [page, "row"]).where((F.col("nx") >= F.col("right")) & (F.col("nx") - F.col("right") <= width * NUMBER_GAP) & (F.abs(F.col("ny") - F.col("my")) <= F.col("height")))
    return near.groupBy(page, "equation").agg(F.min_by("number", F.struct("nx", "number")).alias("number"))


def _letters(text: str | None) -> str:
    return "".join(c for c in (text or "").lower() if c.isalpha() or c.isnumeric())


def _probes(letters: str) -> list[str]:
    """Slices of a sentence, evenly spaced, its begin first."""
    if len(letters) < LEAST_LETTERS:
        return []
    size = min(PROBE, len(letters))
    last = len(letters) - size
    starts = dict.fromkeys(int(last * k / 4 + 0.5) for k in range(5))
    return [letters[s : s + size] for s in starts]


def _aligned(sentences: list[dict], paragraphs: list[str | None]) -> list[int | None]:
    texts, cursor, out, before = [_letters(p) for p in paragraphs], 0, [], None
    for s in sentences:
        letters = _letters(s["text"])
        order = [*range(cursor, len(texts)), *range(cursor)]
        opening = letters[:OPENING]
        found = next((k for k in order if opening in texts[k]), None) if len(opening) >= LEAST_LETTERS else None
        if found is None:
            best = 1
            probes = _probes(letters)
            for k in order:
                score = sum(1 + (n == 0) for n, probe in enumerate(probes) if probe in texts[k])
                if score > best:
                    found, best = k, score
        if found is not None:
            cursor, before = found, (s["block"], found)
        elif before is not None and before[0] == s["block"]:
            found = before[1]
        out.append(found)
    return out


def aligned_sentences(sentences: DataFrame, paragraphs: DataFrame, page: str) -> DataFrame:
    """(page, turn, paragraph): the paragraph (page, place, text) of its page that each sentence (page, turn, block, text) starts in; null if none can be told.

    The next paragraph in reading order with the sentence's opening letters, from the last
    one found on and then from the top; else the one that holds most slices of it. What is
    not found goes on with the sentence before if that is of the same block. Sentences and
    paragraphs of one page are gathered: a page is a sheet of paper, whatever the corpus.
    """
    said = sentences.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("turn", "block", "text"))).alias("sentences"))
    held = paragraphs.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("paragraphs"))
    kinds = dict(said.join(held, page, "left").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                places = [p["place"] for p in row["paragraphs"] or []]
                found = _aligned(row["sentences"], [p["text"] for p in row["paragraphs"] or []])
                out += [(row[page], s["turn"], None if k is None else places[k]) for s, k in zip(row["sentences"], found)]
            columns = list(zip(*out)) or [(), (), ()]
            types = (batch.schema.field(page).type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[page, "turn", "paragraph"])

    return said.join(held, page, "left").mapInArrow(run, f"`{page}` {kinds[page]}, turn long, paragraph long")


def reused_translations(units: DataFrame, cached: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """Translations (page, unit, translation) of a page's units (page, unit, source) that a cache (page, turn, unit, source, translation) still has, and (page, complete).

    The first cached translation of a unit stands if its source is the same; else the first
    one of that source, under whatever unit. Blank translations and the word "translation"
    are none. A page is complete if the cache held exactly its units, and all have one.
    """
    key = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s+", " "))
    usable = (F.trim("translation") != "") & (F.lower(F.trim("translation")) != "translation")
    known = cached.select(page, "turn", "unit", key("source").alias("key"), F.when(usable, F.col("translation")).alias("translation"))
    by_unit = known.groupBy(page, "unit").agg(F.min_by(F.struct("key", "translation"), "turn").alias("own"))
    by_source = known.where("translation is not null").groupBy(page, "key").agg(F.min_by("translation", "turn").alias("like"))
    now = units.select(page, "unit", key("source").alias("key")).join(by_unit, [page, "unit"], "left").join(by_source, [page, "key"], "left")
    same = F.coalesce(F.col("own.key") == F.col("key"), F.lit(False))
    told = now.select(page, "unit", same.alias("same"), F.coalesce(F.when(same, F.col("own.translation")), F.col("like")).alias("translation"))
    counts = cached.groupBy(page).agg(F.count("*").alias("cached"))
    pages = told.groupBy(page).agg(F.count("*").alias("units"), F.count("translation").alias("have"), F.bool_and("same").alias("same")).join(counts, page, "left")
    complete = F.col("same") & (F.col("units") == F.col("have")) & (F.col("units") == F.coalesce("cached", F.lit(0)))
    return told.where("translation is not null").select(page, "unit", "translation"), pages.select(page, complete.alias("complete"))
