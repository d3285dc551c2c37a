"""Lists of search results: each found once, ranked for a typed query, recommended beside a document, parted into reading tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import entity as E
from folioscope.functions.unicode import normal_form
from folioscope.operators.ordered import folded
from folioscope.sources.shared import cut

# Words that say nothing about the subject of a paper, and those that say too little to be required.
COMMON_WORDS = """about after all and arxiv based between bridging for from gap human into logic machine method methods model models new need overview our
paper study system systems that the their this technical toward towards using uses via with you google preprint com cs cl""".split()
GENERIC_WORDS = "attention deep learning mechanism mechanisms network networks neural recurrent research self sequence training".split()
# Results that are shown for a query and beside a document, terms that are told, words of an overview and titles of references that count.
MOST_RANKED, MOST_RECOMMENDED, MOST_TOLD, MOST_TOPICS, MOST_REFERENCES, LEAST_REFERENCE = 20, 10, 4, 12, 4, 8
#: Scopes that are broadcast beside their lists.
FEW_SCOPES = 100_000
# Letters of a term that tells a title apart.
DISTINCTIVE = 8
# Least scores of the tiers (the first one in short lists and in long ones), shares of a list that they may hold, and when a list is long.
TIERS, SHORT_DEEP, LONG_DEEP, LONG_LIST = ("deep_read", "skim", "abstract_only"), 96, 88, 20
LEAST_SCORES, SHARES = (68, 42), (5, 15, 25)


def normal(text: Column) -> Column:
    """Compatible characters spelled out, lower case, letters and digits between single blanks."""
    return E.letters_only(normal_form(text))


def typed_terms(text: Column) -> Column:
    """Terms of a typed query, compatible characters spelled out."""
    return E.query_terms(normal_form(text))


def _subject(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON_WORDS))


def subject_words(text: Column) -> Column:
    """Distinct words of three letters or more that say something about a subject."""
    return F.coalesce(_subject(F.array_distinct(F.split(normal(text), " "))), F.array().cast("array<string>"))


def topic_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, times, place): the subject words of each text, the most frequent first, then by first place.

    If two or more of them are repeated, those are all; ``key`` is unique.
    """
    words = rows.select(key, F.posexplode(_subject(F.split(normal(F.col(text)), " "))).alias("at", "word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    own = Window.partitionBy(key)
    counts = counts.withColumn("repeated", F.count_if(F.col("times") > 1).over(own)).where("repeated < 2 or times > 1")
    return counts.select(key, "word", "times", F.row_number().over(own.orderBy(F.desc("times"), "at")).alias("place"))


def first_seen(rows: DataFrame, scope: str, order: list[str], keys: list[str]) -> DataFrame:
    """Rows of each scope, in order, none of whose keys a kept row before has; null keys say nothing.

    A row that is dropped claims none of its keys, so that the rule depends on the order: a
    scope's rows are streamed through one task, which holds the keys of its kept rows.
    """

    def step(state: dict, row: dict) -> bool:
        own = {(k, row[k]) for k in keys if row[k] is not None}
        seen = state.setdefault("seen", set())
        if own & seen:
            return False
        seen |= own
        return True

    return folded(rows, scope, order, dict, step, "_first", T.BooleanType(), uses=keys).where("_first").drop("_first")


def _keyed(results: DataFrame) -> DataFrame:
    """Titles in normal form and DOIs in lower case."""
    return results.withColumns({"title_key": normal(F.col("title")), "doi_key": F.lower(F.trim("doi"))})


def _asked(keyed: DataFrame, asked: DataFrame | None, on: str) -> DataFrame:
    """The results of each scope, without the document's own record; texts were read before, once for all scopes of a list."""
    if asked is not None:
        keyed = keyed.join(F.broadcast(asked) if asked.count() <= FEW_SCOPES else asked, on)
    same = F.coalesce(F.col("title_key") == normal(F.col("own_title")), F.lit(False)) | F.coalesce(F.col("doi_key") == F.lower(F.trim("own_doi")), F.lit(False))
    return keyed.where(~same)


def ranked_results(results: DataFrame, asked: DataFrame | None = None, on: str = "scope") -> DataFrame:
    """(scope, item, score, place) of result lists (scope, query, own_title, own_doi, turn, item, title, abstract, doi).

    Scopes that share a list come apart from it: ``asked`` (scope, query, own_title,
    own_doi) is joined by the column ``on``. Three for each term of the query that the
    title holds, one for each in the abstract, parts of words included; nothing is dropped
    for holding none. The open document itself and what came before by title or DOI are
    left out; equals keep their order.
    """
    told = _asked(_keyed(results).withColumn("abstract_key", F.when(F.length("abstract") > 0, normal(F.col("abstract")))), asked if asked is None else asked.withColumn("terms", typed_terms(F.col("query"))), on)
    if asked is None:
        told = told.withColumn("terms", typed_terms(F.col("query")))
    held = lambda text: F.size(F.filter("terms", lambda t: F.contains(F.col(text), t)))
    score = 3 * held("title_key") + F.when(F.col("abstract_key").isNotNull(), held("abstract_key")).otherwise(0)
    # The texts stay behind: keys go as digests.
    scored = told.select("scope", "item", "turn", score.alias("score"), F.sha2("title_key", 256).alias("title_key"), "doi_key")
    once = first_seen(scored, "scope", ["turn"], ["title_key", "doi_key"])
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "turn"))
    return once.select("scope", "item", "score", place.alias("place")).where(F.col("place") <= MOST_RANKED)


def contexts(documents: DataFrame) -> DataFrame:
    """(scope, own_title, own_doi, terms, required, references) of documents (scope, name, title, doi, overview, references).

    A title that is a file's name, too long, a number, or made of marks is none. Terms are
    the subject words of title, overview (its topics) and references; of those of title
    and overview one that is not generic is required of what is recommended.
    """
    title = normal(F.col("title"))
    no_title = (title == "") | (title == normal(F.regexp_replace("name", r"(?i)\.pdf$", ""))) | title.rlike(r"^\d{10,}[-_]") | (F.length(title) > 180)
    no_title |= title.rlike(r"(?i)\b(?:references?|bibliography|figure|table|input[-\s]input|eos|pad)\b")
    topics = topic_words(documents.select("scope", "overview"), "scope", "overview").where(F.col("place") <= MOST_TOPICS)
    topics = topics.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("topics"))
    none = F.array().cast("array<string>")
    told = documents.join(topics, "scope", "left").withColumn("own_title", F.when(F.coalesce(no_title, F.lit(True)), None).otherwise(F.trim("title")))
    trimmed = F.transform(F.coalesce("references", none), lambda t: F.trim(F.translate(t, "\n", " ")))
    references = F.slice(F.filter(trimmed, lambda t: F.length(t) >= LEAST_REFERENCE), 1, MOST_REFERENCES)
    told = told.withColumns({"topics": F.coalesce("topics", none), "titled": subject_words(F.col("own_title")), "references": references})
    needed = F.array_distinct(F.concat("titled", "topics"))
    cited = subject_words(F.array_join("references", " | "))
    return told.select(
        "scope", "own_title", F.lower(F.trim("doi")).alias("own_doi"), F.array_distinct(F.concat("titled", "topics", cited)).alias("terms"),
        F.filter(needed, lambda w: ~w.isin(GENERIC_WORDS) & ~w.rlike(r"^\d+$")).alias("required"), F.split(normal_form(F.array_join("references", "\n")), "\n").alias("references"),
    )


def recommended(results: DataFrame, documents: DataFrame, on: str = "scope") -> DataFrame:
    """(scope, item, score, place): what of a document's results (scope, turn, item, title, abstract, doi, citations) is worth reading beside it.

    Scopes that share a list have its column ``on`` beside them in ``documents``.

    Three for each term in the title, one in the abstract, two for each word that the title
    shares with the references; at most four terms count of each. Two terms in the title,
    a long one there and one in the abstract, or two shared with references are evidence
    enough; one of the required terms must be there. Then each title and DOI is kept once,
    by turn, and the best ten are shown: by score, citations (unknown last), title.
    """
    read = _keyed(results).withColumns({"title_words": subject_words(F.col("title")), "abstract_words": subject_words(F.col("abstract"))}).drop("abstract")
    told = contexts(documents)
    rows = _asked(read, told if on == "scope" else told.join(documents.select("scope", on), "scope"), on)
    held = lambda own, terms: F.slice(F.filter(terms, lambda t: F.array_contains(own, t)), 1, MOST_TOLD)
    shared = F.flatten(F.transform("references", lambda r: held(F.filter(F.split(F.lower(r), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3), F.col("title_words"))))
    needed = held(F.array_union("title_words", "abstract_words"), F.col("required"))
    rows = rows.withColumns({
        "in_title": held(F.col("title_words"), F.col("terms")), "in_abstract": held(F.col("abstract_words"), F.col("terms")),
        "shared": F.slice(F.array_distinct(shared), 1, MOST_TOLD), "needed": (F.size("required") == 0) | (F.size(needed) > 0),
    })
    rows = rows.withColumn("score", 3 * F.size("in_title") + F.size("in_abstract") + 2 * F.size("shared"))
    enough = (F.size("in_title") >= 2) | (F.exists("in_title", lambda t: F.length(t) >= DISTINCTIVE) & (F.size("in_abstract") >= 1)) | (F.size("shared") >= 2)
    worth = rows.where(enough & F.col("needed")).select("scope", "item", "turn", "score", "citations", "title", F.sha2("title_key", 256).alias("title_key"), "doi_key")
    once = first_seen(worth, "scope", ["turn"], ["title_key", "doi_key"])
    order = Window.partitionBy("scope").orderBy(F.desc("score"), F.desc(F.coalesce("citations", F.lit(-1))), F.lower("title"), "turn")
    return once.select("scope", "item", "score", F.row_number().over(order).alias("place")).where(F.col("place") <= MOST_RECOMMENDED)


def reading_tiers(rows: DataFrame, scope: str, score: str, confidence: str, tie: str) -> DataFrame:
    """``rows`` with their ``tier``: the best of a scope by score, then confidence, fill quotas one after the other.

    A tier takes the next rows that reach its least score, up to a share of the scope (at
    least one); what no tier takes is passed over. Shares and least scores depend on the
    number of rows. Sorted by score, the rows that reach a bound come first, so that
    places and counts tell the tier.
    """
    size = F.col("_size")
    deep = F.when(size >= LONG_LIST, F.col(score) >= LONG_DEEP).otherwise(F.col(score) >= SHORT_DEEP)
    counts = rows.groupBy(scope).agg(F.count("*").alias("_size"), *(F.count_if(F.col(score) >= x).alias(f"_from_{x}") for x in (LONG_DEEP, SHORT_DEEP, *LEAST_SCORES)))
    quota = lambda share: F.greatest(F.lit(1), F.floor(size * share / 100))
    first = F.least(F.when(size >= LONG_LIST, quota(SHARES[0])).otherwise(1), F.when(size >= LONG_LIST, F.col(f"_from_{LONG_DEEP}")).otherwise(F.col(f"_from_{SHORT_DEEP}")))
    second = F.least(quota(SHARES[1]), F.greatest(F.col(f"_from_{LEAST_SCORES[0]}") - F.col("_deep"), F.lit(0)))
    third = F.least(quota(SHARES[2]), F.greatest(F.col(f"_from_{LEAST_SCORES[1]}") - F.col("_deep") - F.col("_skim"), F.lit(0)))
    counts = counts.withColumn("_deep", first).withColumn("_skim", second).withColumn("_abstract", third).select(scope, "_deep", "_skim", "_abstract")
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(score), F.desc(confidence), tie))
    out = rows.withColumn("_place", place).join(counts, scope)
    ends = (F.col("_deep"), F.col("_deep") + F.col("_skim"), F.col("_deep") + F.col("_skim") + F.col("_abstract"))
    tier = F.when(F.col("_place") <= ends[0], TIERS[0]).when(F.col("_place") <= ends[1], TIERS[1]).when(F.col("_place") <= ends[2], TIERS[2]).otherwise("pass")
    return out.select(*rows.columns, tier.alias("tier"))


def overlap_judged(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(query, record, score): 2 where a record (record, text) holds half of the terms of a query (query, text), 1 from a quarter; others score 0 and are not told.

    Terms have more than three letters. A record that holds a quarter holds one of the
    query's terms that are left without the commonest quarter (but one): candidates come
    from those, and the common terms are only looked up for them.
    """
    of = lambda text: F.filter(F.array_distinct(F.split(F.lower(normal_form(text)), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 3)
    terms = asked.select("query", of(F.col("text")).alias("terms")).where(F.size("terms") > 0).select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    postings = records.select("record", F.explode(of(F.col("text"))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    postings = cut(postings)  # read three times
    spread = postings.groupBy("term").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "term"))
    placed = terms.join(spread, "term", "left").withColumn("rare", place <= F.col("n") - F.ceil(F.col("n") / 4) + 1)
    rare = placed.where("rare").join(postings, "term").groupBy("query", "n", "record").agg(F.count("*").alias("hits"))
    common = placed.where("not rare").select("query", "term")
    more = rare.select("query", "record").join(common, "query").join(postings, ["record", "term"], "left_semi").groupBy("query", "record").agg(F.count("*").alias("more"))
    every = rare.join(more, ["query", "record"], "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0)))
    score = F.when(2 * F.col("hits") >= F.col("n"), 2).when(4 * F.col("hits") >= F.col("n"), 1)
    return every.select("query", "record", score.alias("score")).where("score is not null")
