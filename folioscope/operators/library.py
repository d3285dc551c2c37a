"""Rules of a document library: prefix search, content versions, deletes, validation, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.sources.shared import cut


#: Queries, and tokens that meet their terms, that are broadcast beside the documents.
FEW_QUERIES, FEW_TOKENS = 100_000, 1_000_000


def prefix_search(docs: DataFrame, asked: DataFrame, most: int = 100) -> DataFrame:
    """(query, page, place): documents in which every term of a query starts some token; the newest first, ``most`` at most.

    Terms meet the distinct tokens of the corpus first, which tells how many documents each
    can have. A query's documents are among those of its rarest term: only these are asked
    for its other terms, so that common terms make no rows. Rows that repeat a page add up.
    """
    terms = asked.where("query is not null").select("query", F.explode(F.array_distinct("terms")).alias("term"))
    beside = F.broadcast if asked.count() <= FEW_QUERIES else lambda rows: rows
    held = cut(docs.select("page", F.array_distinct(X.tokens(F.col("text"))).alias("tokens")))
    tokens = held.select("page", F.explode("tokens").alias("token"))
    # A token meets a term by its beginnings of the lengths that terms have.
    lengths = terms.agg(F.collect_set(F.length("term")).alias("lengths"))
    vocabulary = tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(lengths))  # one row
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("token")), lambda n: F.substring("token", F.lit(1), n))
    known = cut(vocabulary.select("token", "df", F.explode(starts).alias("term")).join(beside(terms.select("term").distinct()), "term"))
    spread = known.groupBy("term").agg(F.sum("df").alias("df"))
    rarest = terms.join(spread, "term", "left").groupBy("query").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"), F.collect_set("term").alias("needed"))
    rarest = cut(rarest)
    opening = known.join(beside(rarest.select("query", "term")), "term").select("token", "query")
    likely = tokens.join(F.broadcast(opening) if opening.count() <= FEW_TOKENS else opening, "token").select("query", "page").distinct()
    asking = likely.join(beside(rarest.select("query", "needed")), "query").withColumnRenamed("page", "own")
    met = asking.join(held, F.col("own").eqNullSafe(F.col("page")))
    found = F.filter("needed", lambda t: F.exists("tokens", lambda k: F.startswith(k, t)))
    hits = met.select("query", "page", F.size("needed").alias("n"), found.alias("held")).groupBy("query", "page", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held")).where("held = n")
    # Spark keeps the first rows of each partition before the exchange.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("page")))
    return hits.select("query", "page").withColumn("place", place).where(F.col("place") <= most)


def text_from_positions(index: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """(key, text) of rows (key, word, positions): the words at positions 0 to ``most`` - 1 in order; of two at one position the greater stays.

    The words of a key come together once, as its text is one value anyway, and are put in order there.
    """
    kept = index.select(key, "word", F.filter("positions", lambda p: (p >= 0) & (p < most)).alias("positions")).where(F.size("positions") > 0)
    lists = kept.groupBy(key).agg(F.collect_list(F.struct("word", "positions")).alias("words"))
    placed = F.sort_array(F.flatten(F.transform("words", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("at"), x["word"].alias("word"))))))
    last = lambda x, k: F.coalesce(F.get("placed", k + 1)["at"] != x["at"], F.lit(True))
    return lists.select(key, placed.alias("placed")).select(key, F.array_join(F.transform(F.filter("placed", last), lambda x: x["word"]), " ").alias("text"))


def content_versions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, first, copies): records with equal content are one version, kept under its first key."""
    return docs.groupBy(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def cascade(roots: DataFrame, children: DataFrame, key: str, restricts: Column) -> DataFrame:
    """(key, outcome, children): deletes of ``roots`` with what goes along; a child for which ``restricts`` holds refuses the delete."""
    held = children.join(roots.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("held"), F.bool_or(restricts).alias("bound"))
    bound = F.coalesce(F.col("bound"), F.lit(False))
    out = roots.select(key).join(held, key, "left")
    return out.select(key, F.when(bound, "refused").otherwise("deleted").alias("outcome"), F.when(bound, 0).otherwise(F.coalesce("held", F.lit(0))).cast("long").alias("children"))


def repeated(rows: DataFrame, keys: list[str], fault: str) -> DataFrame:
    """(fault, id) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1").select(F.lit(fault).alias("fault"), F.concat_ws(":", *keys).alias("id"))


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, fault: str) -> DataFrame:
    """(fault, id) of references that no row of ``target`` answers."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(target, F.col(key) == F.col(target_key), "left_anti").select(F.lit(fault).alias("fault"), F.col(key).cast("string").alias("id"))


def csv_cell(value: Column) -> Column:
    """Quoted only where a quote, comma or line break asks for it; null is empty."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def absorbing_sum(value: Column) -> Column:
    """A sum that one unknown makes unknown."""
    return F.when(~F.bool_or(value.isNull()), F.sum(value))


def state_snapshot(jobs: DataFrame, state: str, order: str, ranks: dict[str, int], most: int = 64) -> DataFrame:
    """(state, shown, remaining): the first ``most`` jobs by rank of state and order are shown, the others counted."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[F.col(state)], F.lit(len(ranks)))
    shown = jobs.select(state, order).orderBy(rank, order).limit(most).groupBy(F.col(state).alias("state")).agg(F.count("*").alias("shown"))
    every = jobs.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("jobs"))
    some = F.coalesce("shown", F.lit(0).cast("long"))
    return every.join(shown, "state", "left").select("state", some.alias("shown"), (F.col("jobs") - some).alias("remaining"))


def snapshot_token(rows: DataFrame, by: str, key: str, fields: list[str]) -> DataFrame:
    """(by, token): a digest over the digests of a scope's records in the order of their keys."""
    own = F.sha2(F.concat_ws("|", key, *fields), 256)
    digests = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), own.alias("own"))))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(digests, lambda x: x["own"]), ""), 256).alias("token"))
