"""Short rules over lists: windows of years and pages, orders with a chosen or an unknown value, lone matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pages around the one that is read, nearest first, and paragraphs that are taken from them.
PAGE_WINDOW, MOST_SOURCES = (0, 1, -1, 2, -2), 120
# Pages that answer a question where nothing is indexed, and letters of its terms.
MOST_PAGES, LEAST_TERM = 4, 2
# What a lone match by surname and year is worth.
LONE_MATCH = 0.86


def within_years(rows: DataFrame, year: str, low: int | None, high: int | None) -> DataFrame:
    """Rows of a window of years, open where an end is None; a row of unknown year stays."""
    inside = F.lit(True)
    inside &= F.lit(True) if low is None else F.col(year) >= low
    inside &= F.lit(True) if high is None else F.col(year) <= high
    return rows.where(F.col(year).isNull() | inside)


def scored_first(score: Column, contexts: Column) -> list[Column]:
    """An order: scored rows by their score, then those without one by how often they are cited."""
    return [score.desc_nulls_last(), contexts.desc_nulls_last()]


def pinned_first(chosen: Column, *order: Column) -> list[Column]:
    """An order: the chosen row before all others, which keep theirs."""
    return [F.when(F.coalesce(chosen, F.lit(False)), 0).otherwise(1), *order]


def page_sources(notes: DataFrame, paragraphs: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """(note, page, place, turn): the paragraphs (document, page, place) near a note (note, document, page), those of its own page first, then of the next one, the one before and the two around these."""
    window = F.array(*(F.struct(F.lit(k).alias("near"), (F.col("page") + d).alias("page")) for k, d in enumerate(PAGE_WINDOW)))
    wanted = notes.select("note", "document", F.explode(window).alias("w")).select("note", "document", "w.near", "w.page")
    order = Window.partitionBy("note").orderBy("near", "place")
    met = wanted.join(paragraphs.select("document", "page", "place"), ["document", "page"])
    return met.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).select("note", "page", "place", "turn")


def answering_pages(pages: DataFrame, asked: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(query, page, score, place): of a document's pages (document, page, text) those that hold most terms of a question (query, document, page, text), one more for the page that is read.

    Terms count as often as they are asked, parts of words included; pages that hold none
    are ranked too, by number; blank pages are not.
    """
    terms = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= LEAST_TERM)
    wanted = asked.select("query", "document", F.col("page").alias("current"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
    own = pages.select("document", "page", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("own")).where("own <> ''")
    met = wanted.join(own, "document")
    score = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("own")), t))) + F.when(F.col("page") == F.col("current"), 1).otherwise(0)
    scored = met.select("query", "page", score.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "page")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def lone_matches(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(request, paper, score): the one paper (paper, year, surnames) that has a request's (request, surname, year) surname and year; several are none."""
    known = papers.where("year is not null").select("paper", "year", F.explode(F.array_distinct("surnames")).alias("surname")).where("surname is not null")
    # Papers are counted before requests meet them, so that a common name and year stays one row.
    alone = known.groupBy("surname", "year").agg(F.count("*").alias("papers"), F.min("paper").alias("paper")).where("papers = 1")
    return asked.join(alone, ["surname", "year"]).select("request", "paper", F.lit(LONE_MATCH).alias("score"))
