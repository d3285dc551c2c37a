"""Registered queries of result lists, reading tiers and sentences, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.operators import results, sentences
from folioscope.sources.tables import table

#: Result lists that the documents are dealt to.
LISTS = 40


def result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the results of lists: the first line as title, the rest as abstract, DOIs that some share."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("item"), k.alias("turn"), (k % LISTS).alias("list"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^[^\n]*\n?", "").alias("abstract"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1/D"), F.floor(k / 120).cast("string"))).alias("doi"), F.when(k % 4 != 0, k % 50).alias("citations"),
    )


def askers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions, each of which asks for one of the lists."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("scope"), (F.col("item_id") % LISTS).alias("list"), F.col("text").alias("query"), F.lit("none of them").alias("own_title"), F.lit("10.1/d1").alias("own_doi"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each benchmark question."""
    return result_lists(spark, sf_dir).join(askers(spark, sf_dir), "list").drop("list")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as open documents: every fourth has a number for a title."""
    k = F.col("item_id")
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        k.alias("scope"), F.concat(k.cast("string"), F.lit(".pdf")).alias("name"), F.when(k % 4 == 0, k.cast("string")).otherwise(F.array_join(F.slice(words, 1, 6), " ")).alias("title"),
        F.when(k % 5 == 0, "10.1/D2").alias("doi"), F.col("text").alias("overview"), F.array(F.array_join(F.slice(words, 7, 5), " "), F.array_join(F.slice(words, 12, 4), " "), F.lit("short")).alias("references"),
    )


def benchmark_once_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each list that neither title nor DOI repeats."""
    rows = found(spark, sf_dir).select("scope", "turn", "item", "doi", F.substring(results.normal(F.col("title")), 1, 12).alias("key"))
    return results.first_seen(rows, "scope", ["turn"], ["key", "doi"]).select("scope", "item")


def benchmark_typed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.ranked_results(result_lists(spark, sf_dir), askers(spark, sf_dir), "list")


def benchmark_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = subjects(spark, sf_dir).withColumn("list", F.col("scope") % LISTS)
    return results.recommended(result_lists(spark, sf_dir), documents, "list")


def benchmark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject words of a question: those that it repeats, if there are two or more, else all, by frequency."""
    return results.topic_words(table(spark, sf_dir, "benchmark"), "item_id", "text")


def benchmark_overlap_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many whole documents hold a half or a quarter of a question's terms."""
    judged = results.overlap_judged(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "text"))
    return judged.groupBy(F.col("query").alias("item_id"), "score").agg(F.count("*").alias("documents"), F.min("record").alias("first"))


def customer_reading_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assessed citations of their customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.pmod(F.col("o_totalprice"), F.lit(101.0))).cast("int").alias("score"), F.month("o_orderdate").alias("confidence"))
    return results.reading_tiers(orders, "o_custkey", "score", "confidence", "o_orderkey").select("o_custkey", "o_orderkey", "score", "tier")


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sentences.with_markers(sentences.sentences(F.col("text")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", own.alias("s"), F.size(sentences.sentence_breaks(F.col("text"))).alias("breaks"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.length(F.array_join("s", "")).alias("chars"), F.substring(F.element_at("s", -1), 1, 60).alias("last"), "breaks")


def document_example_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of the word that the middle of a document stands in."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    start = F.length(F.regexp_extract(F.substring(F.col("text"), F.lit(1), half), r"(?s)^(.*\s)?", 0))
    rows = docs.select("doc_id", "text", start.alias("start"))
    end = F.col("start") + F.length(F.regexp_extract(F.substring(F.col("text"), F.col("start") + 1, F.lit(200)), r"^\S+", 0))
    # Generated rather than filtered: a filter would be computed again below, with the place of the word for each sentence.
    found = F.filter(F.array(sentences.example_sentence(F.col("text"), F.col("start"), F.col("end"))), lambda e: e.isNotNull())
    return rows.select("doc_id", "text", "start", end.alias("end")).select("doc_id", F.inline(found))


QUERIES = {
    f.__name__: f
    for f in (
        benchmark_once_seen, benchmark_typed_ranking, benchmark_recommended, benchmark_keywords, benchmark_overlap_judge, customer_reading_tiers, document_sentences, document_example_sentences,
    )
}

_LIST = "['" + "','".join(results.COMMON_WORDS) + "']"
_GENERIC = "['" + "','".join(results.GENERIC_WORDS) + "']"
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SUBJECT = "list_filter({0}, lambda w: length(w) >= 3 and not list_contains(" + _LIST + ", w))"
_FOUND = f"""items as (select doc_id item, item_id scope, b.text query, split_part(coalesce(d.text, ''), chr(10), 1) title, substr(coalesce(d.text, ''), length(split_part(coalesce(d.text, ''), chr(10), 1)) + 2) abstract,
 case when doc_id % 3 = 0 then '10.1/d' || (doc_id // 120) end doi, case when doc_id % 4 <> 0 then doc_id % 50 end citations from documents d join benchmark b on doc_id % {LISTS} = item_id % {LISTS}),
keyed as (select *, {_NORMAL.format('title')} key from items)"""
#: Item after item of each list, with the keys that were taken so far.
_ONCE = """, numbered as (select *, row_number() over (partition by scope order by item) n from {rows}),
walk as (select scope, 0::bigint n, null::bigint item, []::varchar[] seen, false kept from (select distinct scope from numbered) union all
 select r.scope, r.n, r.item, case when list_has_any(w.seen, list_filter(['t:' || key, 'd:' || doi], lambda x: x is not null)) then w.seen else list_concat(w.seen, list_filter(['t:' || key, 'd:' || doi], lambda x: x is not null)) end,
 not list_has_any(w.seen, list_filter(['t:' || key, 'd:' || doi], lambda x: x is not null)) from walk w join numbered r on r.scope = w.scope and r.n = w.n + 1)"""

ORACLES = {
    "benchmark_once_seen": f"with recursive {_FOUND}, short as (select scope, item, doi, substr(key, 1, 12) key from keyed)" + _ONCE.format(rows="short") + " select scope, item from walk where kept",
    "benchmark_typed_ranking": f"with recursive {_FOUND}, others as (select * from keyed where key <> 'none of them' and coalesce(doi <> '10.1/d1', true))"
    + _ONCE.format(rows="others")
    + f""", terms as (select item_id scope, list_filter(list_distinct(string_split({_NORMAL.format('text')}, ' ')), lambda w: length(w) >= 3 and not list_contains({E.QUERY_STOP_WORDS!r}, w)) terms from benchmark),
scored as (select k.scope, k.item, 3 * len(list_filter(terms, lambda t: contains(key, t))) + len(list_filter(terms, lambda t: contains({_NORMAL.format('abstract')}, t))) score from walk w join keyed k on k.scope = w.scope and k.item = w.item join terms t on t.scope = k.scope where kept)
select scope, item, cast(score as int) score, cast(row_number() over (partition by scope order by score desc, item) as int) place from scored qualify place <= 20""",
    "benchmark_keywords": f"""with w as (select item_id, {_SUBJECT.format("string_split(" + _NORMAL.format('text') + ", ' ')")} w from benchmark), u as (select item_id, unnest(w) word, generate_subscripts(w, 1) p from w),
c as (select item_id, word, count(*) times, min(p) p from u group by 1, 2), r as (select *, count(*) filter (times > 1) over (partition by item_id) repeated from c)
select item_id, word, times, cast(row_number() over (partition by item_id order by times desc, p) as int) place from r where repeated < 2 or times > 1""",
    "benchmark_overlap_judge": r"""with q as (select item_id, list_filter(list_distinct(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')), lambda w: length(w) > 3) terms from benchmark),
t as (select item_id, len(terms) n, unnest(terms) term from q), d as (select distinct doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) term from documents),
s as (select item_id, doc_id, n, count(*) hits from t join d using (term) group by all), j as (select item_id, doc_id, case when 2 * hits >= n then 2 when 4 * hits >= n then 1 end score from s)
select item_id, cast(score as int) score, count(*) documents, min(doc_id) "first" from j where score is not null group by 1, 2""",
    "customer_reading_tiers": """with o as (select o_custkey, o_orderkey, cast(floor(o_totalprice % 101) as int) score, month(o_orderdate) c from orders),
n as (select *, row_number() over (partition by o_custkey order by score desc, c desc, o_orderkey) p, count(*) over (partition by o_custkey) size from o),
a as (select *, p <= case when size >= 20 then greatest(1, size * 5 // 100) else 1 end and score >= case when size >= 20 then 88 else 96 end deep from n),
b as (select *, count(*) filter (deep) over (partition by o_custkey) d from a),
e as (select *, not deep and score >= 68 and p - d <= greatest(1, size * 15 // 100) skim from b), f as (select *, count(*) filter (skim) over (partition by o_custkey) s from e)
select o_custkey, o_orderkey, score, case when deep then 'deep_read' when skim then 'skim' when score >= 42 and p - d - s <= greatest(1, size * 25 // 100) then 'abstract_only' else 'pass' end tier from f""",
}
