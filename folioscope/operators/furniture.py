"""Running headers and footers: runs of words that the pages of a document repeat at their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.components import looked_up
from folioscope.sources.shared import cut

# Pages that must repeat a run, and their share; words of the shortest and of the longest run; how often runs are looked for.
LEAST_PAGES, LEAST_SHARE, SHORTEST, LONGEST, ROUNDS = 3, 0.3, 2, 16, 3
EDGES = ("start", "end")
#: Scopes whose bounds are broadcast.
FEW_SCOPES = 100_000


def _edge(words: Column, edge: str, size: int) -> Column:
    """The words of an edge, outermost first, with numbers folded."""
    cut = F.slice(words, 1, size) if edge == "start" else F.reverse(F.slice(words, F.greatest(F.size(words) - size + 1, F.lit(1)), size))
    return F.transform(cut, lambda w: F.regexp_replace(w, "[0-9]+", "#"))


def repeated_edges(pages: DataFrame, scope: str, page: str, words: str) -> DataFrame:
    """(scope, edge, run, pages): the run (outermost word first) that the most pages of a scope share at an edge; of equals the longest, then the first seen.

    Runs have 2 to 16 words and stand on three pages and 30 % of them at least; pages have
    more words than the run. Only the outermost words leave a page.
    """
    own = pages.select(F.col(scope).alias("scope"), F.col(page).alias("page"), F.size(words).alias("n"), *(_edge(F.col(words), e, LONGEST).alias(e) for e in EDGES))
    both = own.select("scope", "page", "n", F.explode(F.array(*(F.struct(F.lit(e).alias("edge"), F.col(e).alias("w")) for e in EDGES))).alias("x")).select("scope", "page", "n", "x.*")
    sizes = F.filter(F.array(*map(F.lit, range(SHORTEST, LONGEST + 1))), lambda k: k < F.col("n"))
    runs = both.select("scope", "page", "edge", "w", F.explode(sizes).alias("size"))
    counts = runs.groupBy("scope", "edge", "size", F.slice("w", F.lit(1), F.col("size")).alias("run")).agg(F.count("*").alias("pages"), F.min("page").alias("first"))
    least = pages.groupBy(F.col(scope).alias("scope")).agg(F.greatest(F.lit(LEAST_PAGES), F.ceil(F.count("*") * LEAST_SHARE)).alias("least"))
    # Scopes are joined where they are few: no task reads all runs of a large one.
    least = F.broadcast(least) if least.count() <= FEW_SCOPES else least
    enough = counts.where(F.col("pages") >= LEAST_PAGES).join(least, "scope").where(F.col("pages") >= F.col("least"))
    best = Window.partitionBy("scope", "edge").orderBy(F.desc("pages"), F.desc("size"), "first")
    return enough.withColumn("turn", F.row_number().over(best)).where("turn = 1").select(F.col("scope").alias(scope), "edge", "run", "pages")


def _copies(words: Column, run: Column, edge: str) -> Column:
    """How many words the copies of a run at an edge take; the last words of a page stay."""
    m, n = F.size(run), F.size(words)

    def more(found: Column, k: Column) -> Column:
        piece = F.slice(words, k * m + 1, m) if edge == "start" else F.reverse(F.slice(words, n - (k + 1) * m + 1, m))
        goes = (found == k) & (F.transform(piece, lambda w: F.regexp_replace(w, "[0-9]+", "#")) == run)
        return F.when(goes, k + 1).otherwise(found)

    # A page has at most so many copies of a run, with a word beside them; only the first that fails is compared.
    most = F.floor((n - 1) / m).cast("int")
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), F.lit(0), more)).otherwise(0) * m


def _trimmed(words: Column, runs: Column) -> Column:
    """Words without the copies of runs (edge, run), which go one after the other."""

    def step(own: Column, r: Column) -> Column:
        front = F.slice(own, _copies(own, r["run"], "start") + 1, F.size(own))
        back = F.slice(own, F.lit(1), F.size(own) - _copies(own, r["run"], "end"))
        return F.when(r["edge"] == EDGES[0], front).otherwise(back)

    return F.aggregate(runs, words, step)


def without_furniture(pages: DataFrame, scope: str, page: str, text: str) -> DataFrame:
    """``pages`` with ``body``: the words between running headers and footers, which are looked for three times, as one may hide another.

    A document of fewer than three pages keeps its text; a header that stands twice on a
    page goes twice. The runs of a round, two a document at most, are kept; pages are not:
    their words are trimmed anew by all runs so far. Large documents are looked up in a
    bounded broadcast table.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    sizes = cut(pages.groupBy(scope).agg(F.count("*").alias("_pages")).where(F.col(scope).isNotNull()))
    none = F.array().cast("array<struct<turn:int,edge:string,run:array<string>>>")
    held, known = sizes.withColumn("_runs", none), None
    for turn in range(ROUNDS + 1):
        out = looked_up(pages.where(F.col(scope).isNotNull()), held, scope).withColumn("_words", _trimmed(words, F.col("_runs")))
        if turn == ROUNDS:
            break
        place = F.when(F.col("edge") == EDGES[0], 2 * turn).otherwise(2 * turn + 1)
        found = cut(repeated_edges(out, scope, page, "_words").select(scope, F.struct(place.alias("turn"), "edge", "run").alias("r")))
        known = found if known is None else known.union(found)
        held = sizes.join(known.groupBy(scope).agg(F.array_sort(F.collect_list("r")).alias("_runs")), scope, "left").withColumn("_runs", F.coalesce("_runs", none))
    body = F.when(F.col("_pages") < LEAST_PAGES, F.col(text)).otherwise(F.array_join("_words", " "))
    alone = pages.where(F.col(scope).isNull()).withColumn("body", F.array_join(words, " "))
    return out.withColumn("body", body).select(*pages.columns, "body").unionByName(alone)
