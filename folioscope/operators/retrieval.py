"""Lexical and vector retrieval."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.sources.shared import cut

# What the parts of a passage's score count, and from where a passage is kept.
PHRASE, LEXICAL, COVERAGE, SIMILAR = 12.0, 2, 4, 3
LEAST_COVERAGE, LEAST_SIMILAR = 0.34, 0.1
#: Against rounding, where bounds of scores are compared; queries whose bounds are broadcast.
SLACK, FEW_QUERIES = 1e-6, 100_000
#: Rows of a block and asking vectors of a part that meet it, and of those that are scored at once; blocks are smaller where cores would idle.
ROW_BLOCK, LEAST_BLOCK, ASK_BLOCK, ASK_STEP = 65_536, 4096, 1024, 64
#: Components up to here have finite products.
FINITE = 1e100
# What a confident match has, and its lead.
CONFIDENT, LEAD = 0.4, 0.04


def index_chunks(docs: DataFrame) -> DataFrame:
    """(page, chunk, text) of every chunk of every document."""
    return docs.select(F.col("doc_id").alias("page"), F.posexplode(X.chunks(F.col("text"))).alias("chunk", "text"))


def ranked_passages(docs: DataFrame, asked: DataFrame, top: int = 5) -> DataFrame:
    """The best passages of each query (item_id, text): phrase, TF-IDF, coverage and trigram scores added up.

    Tokens of the chunks meet those of the queries by equality, and what they share is
    counted. Of a query that has enough passages by its tokens alone, only those that the
    trigrams (at most ``SIMILAR``) or the phrase can still lift to the last of them are
    looked at again, in their text; a phrase of three tokens or more stands only where all
    tokens but its outer ones do. Other queries meet all chunks by their trigrams.

    Pairs of a chunk and a query are made where the asked tokens of a chunk stand together,
    once for the bounds and once for what they leave, and are neither exchanged nor kept.
    """
    chunk = index_chunks(docs)
    key = ["page", "chunk"]
    query = asked.select("item_id", X.normalised(F.col("text")).alias("phrase"), X.tokens(F.col("text")).alias("words"), X.trigrams(F.col("text")).alias("grams"))
    query = query.where(F.size("words") > 0)
    # Repeated query words count as often as they are asked.
    words = query.select("item_id", F.size("words").alias("asked"), F.explode("words").alias("token")).groupBy("item_id", "asked", "token").agg(F.count("*").alias("times"))
    total = chunk.agg(F.count("*").alias("chunks"))
    few = asked.count() <= FEW_QUERIES
    beside = F.broadcast if few else lambda rows: rows
    wanted = words.select("token").distinct()
    df = chunk.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).join(beside(wanted), "token").groupBy("token").agg(F.count("*").alias("df"))
    weights = words.join(df, "token").crossJoin(total).select("item_id", "asked", "token", "times", (F.log((F.col("chunks") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = cut(weights)
    occurrences = chunk.select(*key, F.explode(X.tokens(F.col("text"))).alias("token")).join(beside(wanted), "token")
    asked_tokens = occurrences.repartition(*key).groupBy(*key, "token").agg(F.count("*").alias("tf"))
    lexical = asked_tokens.join(beside(weights), "token").groupBy("item_id", *key).agg(
        F.sum(F.col("times") * (1 + F.log("tf")) * F.col("idf")).alias("lexical"), (F.sum("times") / F.first("asked")).alias("coverage"), F.first("asked").alias("asked")
    )
    lexical = lexical.withColumn("base", LEXICAL * F.col("lexical") + COVERAGE * F.col("coverage"))

    # What the last of the passages that are kept by their tokens alone has at least.
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("base")))
    last = lexical.where((F.col("coverage") >= LEAST_COVERAGE) & (F.col("asked") >= 3)).select("item_id", "base", place.alias("place")).where(F.col("place") <= top)
    last = last.where((F.col("place") == top) & (F.col("base") > SIMILAR + SLACK)).select("item_id", F.col("base").alias("least"))
    last = cut(last)
    met = lexical.join(beside(last), "item_id")
    phrased = F.col("coverage") * F.col("asked") >= F.col("asked") - 2 - SLACK
    near = met.where((F.col("base") + SIMILAR >= F.col("least") - SLACK) | phrased).select("item_id", *key, "lexical", "coverage")
    near = near.join(chunk, key).join(beside(query.select("item_id", "phrase", "grams")), "item_id")
    own = X.trigrams(F.col("text"))
    shared = F.size(F.array_intersect(own, "grams")) / F.greatest(F.size(own), F.size("grams"), F.lit(1))
    phrase = F.when(X.normalised(F.col("text")).contains(F.col("phrase")), PHRASE).otherwise(0.0)
    scored = near.select("item_id", *key, "lexical", "coverage", shared.alias("similar"), phrase.alias("phrase"))

    others = cut(query.join(last, "item_id", "left_anti"))
    if not others.isEmpty():
        scored = scored.unionByName(_by_trigrams(chunk, others, lexical.join(others.select("item_id"), "item_id", "left_semi")))
    kept = scored.where((F.col("phrase") > 0) | (F.col("coverage") >= LEAST_COVERAGE) | (F.col("similar") >= LEAST_SIMILAR))
    kept = kept.withColumn("score", F.round(F.col("phrase") + LEXICAL * F.col("lexical") + COVERAGE * F.col("coverage") + SIMILAR * F.col("similar"), 9))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "page", "chunk")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    first = F.first("score").over(order)
    return best.select("item_id", "rank", "page", "chunk", F.round("score", 4).alias("score"), F.floor(F.col("score") / first * 100 + 0.5).alias("relevance"))


def _by_trigrams(chunk: DataFrame, query: DataFrame, lexical: DataFrame) -> DataFrame:
    """Parts of the score of all chunks that share a token, a trigram or the phrase with a query."""
    key = ["page", "chunk"]
    own = chunk.select(*key, X.trigrams(F.col("text")).alias("own")).select(*key, F.size("own").alias("n"), F.explode("own").alias("gram"))
    wanted = query.select("item_id", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    # Several queries ask for one trigram: they come along as a list, so that a chunk's trigram is joined once.
    lists = wanted.groupBy("gram").agg(F.collect_list(F.struct("item_id", "m")).alias("items"))
    met = own.join(lists, "gram").select(*key, "n", F.explode("items").alias("x")).groupBy("x.item_id", "x.m", *key, "n").agg(F.count("*").alias("shared"))
    similar = met.select("item_id", *key, (F.col("shared") / F.greatest("n", "m")).alias("similar"), (F.col("shared") == F.col("m")).alias("whole"))

    pairs = query.where(F.size("grams") == 0).select("item_id", F.col("phrase").alias("pair"))  # a phrase of one pair of letters
    letters = chunk.select(*key, X.normalised(F.col("text")).alias("t"))
    letters = letters.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(..))."), F.lit(1)))).alias("pair"))
    held = letters.join(pairs, "pair").select("item_id", *key)
    likely = similar.where("whole").select("item_id", *key).join(query.select("item_id", "phrase"), "item_id")
    phrases = likely.join(chunk, key).where(X.normalised(F.col("text")).contains(F.col("phrase"))).select("item_id", *key).union(held)

    zero = F.lit(0.0)
    parts = lexical.select("item_id", *key, "lexical", "coverage", zero.alias("similar"), zero.alias("phrase"))
    parts = parts.union(similar.select("item_id", *key, zero, zero, "similar", zero)).union(phrases.select("item_id", *key, zero, zero, zero, F.lit(PHRASE)))
    return parts.groupBy("item_id", *key).agg(*(F.sum(c).alias(c) for c in ("lexical", "coverage", "similar", "phrase")))


def _half_up(x: float) -> decimal.Decimal:
    """A score as Spark rounds it."""
    return decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP)


def _two_best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the two best scores, rounded ones, ties to smaller ids; the ids stand in order and -inf takes no part."""
    least = np.partition(scores, -2)[-2] if len(scores) > 1 else -np.inf
    at = np.flatnonzero((scores >= least - 2e-6) & (scores > -np.inf))
    scaled = scores[at] * 1e6
    whole = np.floor(scaled + 0.5)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[k] = float(_half_up(scores[at[k]]).scaleb(6))
    return at[np.lexsort((ids[at], -whole))[:2]]


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vectors of a block in one row, by id."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), int(pdf["kind"].iloc[0]))
    return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})


def _blocks(rows: DataFrame, number: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(number)).cast("int"))
    return cut(dealt.groupBy("kind", "block").applyInPandas(_packed, "kind int, block int, ids binary, x binary"))


def _best_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block of rows, and behind it the parts of the asking vectors: the two best rows of each, so that no pair is a row of its own."""
    for pdf in batches:
        for r in pdf.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            x = np.frombuffer(r.x, np.float64).reshape(len(ids), r.kind)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            if r.step == 0:
                held, rows, norms = ids, x, norm
                continue
            out = []
            for low in range(0, len(ids), ASK_STEP):
                part = slice(low, low + ASK_STEP)
                scores = (x[part] @ rows.T) / np.maximum(norm[part, None] * norms[None, :], 1e-12)
                for query_id, own in zip(ids[part].tolist(), scores):
                    own[np.searchsorted(held, query_id, "left") : np.searchsorted(held, query_id, "right")] = -np.inf
                    out += [(query_id, int(held[k]), float(own[k])) for k in _two_best(own, held)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def confident_matches(vectors: DataFrame, floor: float = CONFIDENT, lead: float = LEAD) -> DataFrame:
    """The nearest other vector of each asking one (ids divisible by 100), if it is near enough and ahead of the next.

    Every asking vector meets every row: parts of the asking ones go to blocks of rows,
    which multiply them as matrices and send two rows for each. Vectors without, or with
    endless components, and those of another length meet the others pair by pair.
    """
    unit = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) <= FINITE, F.lit(False)))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), unit.alias("v"))
    rows = rows.withColumn("kind", F.when(F.coalesce(sound, F.lit(False)), F.size("v")).otherwise(-1))
    asks = rows.where("vec_id % 100 = 0")
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(rows.where("kind >= 0"), max(1, -(-n // ROW_BLOCK), min(cores, n // LEAST_BLOCK)))
    parts = _blocks(asks.where("kind >= 0"), max(1, -(-asks.count() // ASK_BLOCK)))
    sent = parts.select("kind", "ids", "x").join(F.broadcast(blocks.select("kind", "block")), "kind")  # a number for each block
    met = blocks.withColumn("step", F.lit(0)).unionByName(sent.withColumn("step", F.lit(1))).repartition("kind", "block").sortWithinPartitions("kind", "block", "step")
    pairs = met.mapInPandas(_best_of_blocks, "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))
    kinds = rows.groupBy("kind").count().limit(2).collect()
    if len(kinds) > 1 or any(k["kind"] < 0 for k in kinds):
        pairs = pairs.unionByName(_odd_pairs(rows, asks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.select("*", F.row_number().over(order).alias("r")).where("r <= 2")
    best = ranked.groupBy("query_id").agg(F.min_by("vec_id", "r").alias("vec_id"), F.max("score").alias("score"), F.when(F.count("*") > 1, F.min("score")).alias("next_score"))
    return best.select("*", ((F.col("score") >= floor) & F.coalesce(F.col("score") - F.col("next_score") >= lead, F.lit(True))).alias("confident"))


def _odd_pairs(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Scores of pairs of different kinds, or without a kind."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    own = asks.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), norm("v").alias("qn"), F.col("kind").alias("asked"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # Rows meet the asking ones part by part: an equi-join, whichever side is small.
    parts = max(1, -(-asks.count() // ASK_BLOCK))
    own = own.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    met = rows.withColumn("norm", norm("v")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(own, "part")
    met = met.where("vec_id <> query_id and (kind <> asked or kind < 0)")
    return met.select("query_id", "vec_id", F.round(dot / F.greatest(F.col("norm") * F.col("qn"), F.lit(1e-12)), 6).alias("score"))
