"""Registered queries of text rules, page furniture, questions and citation keys, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.functions import interchange as I
from folioscope.functions import text as X
from folioscope.operators import discovery, furniture
from folioscope.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def document_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a document for a word in its middle and one that is not there."""
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    terms = F.array(F.get(words, F.floor(F.size(words) / 2).cast("int")), F.lit("qzx"))
    return _texts(spark, sf_dir).select("doc_id", X.snippet(F.col("text"), terms).alias("snippet"))


def conversation_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("## "), F.col("role"), F.lit(" says\n- $E_{0} = \\alpha mc^2$ "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.source_plain(marked).alias("plain"))


def document_layer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("eﬃcient re\x02lated well- \n known "), F.coalesce("text", F.lit("")))
    broken = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.repeat(F.lit("�"), 5)).otherwise(F.lit(""))
    text = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(broken, F.substring(F.coalesce("text", F.lit("")), 1, 200)))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.layer_clean(raw).alias("clean"), X.readable(text).alias("readable"))
    return rows.select("doc_id", F.length("clean").alias("chars"), F.substring("clean", 1, 60).alias("begins"), "readable")


def order_expanded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, reversed and too long ones, and what is no number."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    marker = F.concat(text(k % 50), F.lit(", "), text(k % 7), F.lit(" - "), text(k % 7 + k % 4), F.lit("; "), text(k % 50), F.lit(", "), text(k % 9 + 5), F.lit("-"), text(k % 9), F.lit(",1-"), text(k % 3 * 100 + 1), F.lit(";x2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.expanded_numbers(marker), ",").alias("numbers"))


def part_number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with units in either case, with markup, and with other words."""
    k = F.col("p_partkey")
    price = F.format_number(F.round("p_retailprice", 2), 2)
    forms = [price, F.concat(F.lit("**"), price, F.lit("** %")), F.concat(price, F.lit("k")), F.concat(F.lit("_-"), price, F.lit("_M")), F.concat(F.lit("about "), price)]
    cell = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    value, unit = X.number_cell(cell)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("number"), unit.alias("unit"))


def document_overview_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six pages of each source, its documents in order, that tell most of it."""
    rows = _texts(spark, sf_dir).where(F.trim("text") != "").select("source", "doc_id", "text")
    first = rows.groupBy("source").agg(F.min("doc_id").alias("first"))
    score = F.when(F.col("doc_id") == F.col("first"), discovery.FIRST_PAGE).otherwise(0)
    for pattern, weight in discovery.OVERVIEW_HINTS:
        score += F.when(F.col("text").rlike(pattern), weight).otherwise(0)
    scored = rows.join(F.broadcast(first), "source").select("source", "doc_id", score.alias("score"))  # a handful of sources
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= discovery.OVERVIEW_PAGES)


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source, under a header with a number and above a footer that some lack."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Journal of "), F.col("source"), F.lit(" | VOL 26 | "), k, F.lit(" "), F.col("text"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" www.example.org page "), k)).otherwise(""))
    return _texts(spark, sf_dir).where("source is not null").select("source", "doc_id", text.alias("text"))


def document_edge_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that the pages of a source repeat at their edges, outermost word first."""
    pages = _printed(spark, sf_dir).withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return furniture.repeated_edges(pages, "source", "doc_id", "words").withColumn("run", F.array_join("run", " "))


def document_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = furniture.without_furniture(_printed(spark, sf_dir), "source", "doc_id", "text")
    return out.select("doc_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("body_sha256"))


def order_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose keys are made of surname, year and a word; a key that an earlier entry has gets the id behind it."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    title = F.concat(F.lit("Ü {"), F.regexp_replace("o_orderpriority", "^.-", ""), F.lit("} {study}\\ of "), F.col("c_name"))
    author = F.concat(F.col("c_name"), F.lit(" "), F.initcap("c_mktsegment"))
    rows = joined.select(
        k.alias("id"), title.alias("title"), F.when(k % 6 != 0, F.array(author, F.lit("Bo Li"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(k % 7 != 0, year).alias("year"),
        F.when(k % 2 == 0, F.concat(F.lit("Venue "), F.col("c_mktsegment"))).alias("venue"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"),
        F.when(k % 5 == 0, "2401.00001").alias("arxiv"), F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    keyed = discovery.citation_keys(rows, "id")
    return keyed.select(F.col("id").alias("o_orderkey"), "citation_key", I.bibtex(F.col("citation_key"), *map(F.col, ("title", "authors", "year", "venue", "doi", "arxiv", "tags"))).alias("entry"))


def document_keyword_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of the form ``- **term**: definition``, and others that are none."""
    answer = "- **alpha**: first letter\n1) **beta :** second **one**\n * **gamma** – third \n- delta: no\n+ **:** no\n"
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.concat(F.lit(answer), F.col("text")), "\n")).alias("line", "text"))
    found = lines.select("doc_id", "line", I.keyword_entry(F.col("text")).alias("e")).where("e is not null")
    return found.select("doc_id", "line", "e.term", "e.definition")


def benchmark_question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.question_parts(table(spark, sf_dir, "benchmark"))


def document_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that holds a part of a question as it stands, for all parts, and how many do."""
    return discovery.first_pages_of_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def conversation_memory_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as memories: two for each term of a question that one holds, parts of words included; one where nothing is asked."""
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 40).alias("turned"), "item_id", F.when(F.col("item_id") % 9 == 0, "").otherwise(F.col("text")).alias("asked"))
    asked = asked.select("turned", "item_id", E.query_terms(F.col("asked")).alias("terms"))
    rows = table(spark, sf_dir, "conversations").join(asked, F.col("conv_id") % 40 == F.col("turned"))
    return rows.select("conv_id", "turn", "item_id", discovery.memory_relevance(F.col("terms"), F.col("text")).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        document_snippets, conversation_plain, document_layer_clean, order_expanded_citations, part_number_cells, document_overview_scores, document_edge_furniture, document_without_furniture,
        order_bibtex, document_keyword_entries, benchmark_question_parts, document_first_pages, conversation_memory_relevance,
    )
}

_FLAT = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_ASKS = "['" + "','".join(E.QUERY_STOP_WORDS) + "']"
_PRINTED = """pages as (select source, doc_id, 'Journal of ' || source || ' | VOL 26 | ' || doc_id || ' ' || text || case when doc_id % 5 <> 0 then ' www.example.org page ' || doc_id else '' end t from documents where text is not null and source is not null)"""

ORACLES = {
    "document_snippets": r"""with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) s from documents where text is not null),
c as (select *, greatest(position(string_split(lower(s), ' ')[len(string_split(lower(s), ' ')) // 2 + 1] in lower(s)) - 1, 0) m from f),
r as (select *, greatest(m - 120, 0) r from c),
b as (select *, case when r > 0 and position(' ' in substr(s, r + 1)) > 0 and r + position(' ' in substr(s, r + 1)) - 1 < m then r + position(' ' in substr(s, r + 1)) else r end b from r),
e as (select *, least(length(s), b + 360) e from b),
p as (select *, case when e < length(s) then length(substr(s, 1, e + 1)) - position(' ' in reverse(substr(s, 1, e + 1))) else e end p from e),
w as (select doc_id, s, b, case when e < length(s) and position(' ' in reverse(substr(s, 1, e + 1))) = 0 then e when p > b then p else e end e from p)
select doc_id, case when b > 0 then '…' else '' end || substr(s, b + 1, e - b) || case when e < length(s) then ' …' else '' end snippet from w""",
    "conversation_plain": r"""select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('## ' || role || ' says' || chr(10) || '- $E_{0} = \alpha mc^2$ ' || coalesce(text, ''), '(?m)^\s*(?:#{1,6}|[-*+•])\s+', '', 'g'), '\$+', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g'), '[{}^_]', ' ', 'g'), '\s+', ' ', 'g')) plain from conversations""",
    "document_layer_clean": r"""with c as (select doc_id, 'efficient related well-known ' || trim(regexp_replace(regexp_replace(coalesce(text, ''), '-[ \t]*\r?\n[ \t]*', '-', 'g'), '\s+', ' ', 'g')) c, case when doc_id % 5 = 0 then '' else case when doc_id % 5 = 1 then repeat(chr(65533), 5) else '' end || substr(coalesce(text, ''), 1, 200) end t from documents)
select doc_id, cast(length(trim(c)) as int) chars, substr(trim(c), 1, 60) begins, t <> '' and length(t) - length(regexp_replace(t, '[\p{Cc}\p{Co}\x{FFFD}]', '', 'g')) <= length(t) * 0.02 readable from c""",
    "order_expanded_citations": """with x as (select o_orderkey k, list_concat(list_concat([k50], range(a, a + o_orderkey % 4 + 1)), case when o_orderkey % 3 * 100 + 1 > 101 then [] else range(1, o_orderkey % 3 * 100 + 2) end) n from (select o_orderkey, o_orderkey % 50 k50, o_orderkey % 7 a from orders)),
u as (select k, unnest(n) v, unnest(range(1, len(n) + 1)) p from x), f as (select k, v, min(p) p from u group by k, v) select k o_orderkey, string_agg(cast(v as varchar), ',' order by p) numbers from f group by k""",
    "part_number_cells": """select p_partkey, case when p_partkey % 5 <> 4 then round(p_retailprice, 2) * case when p_partkey % 5 = 3 then -1 else 1 end end "number", case when p_partkey % 5 <> 4 then ['', '%', 'K', 'M'][cast(p_partkey % 5 + 1 as int)] end unit from part""",
    "document_overview_scores": r"""with r as (select source, doc_id, text, min(doc_id) over (partition by source) f from documents where text is not null and trim(text) <> ''),
s as (select source, doc_id, cast(case when doc_id = f then 8 else 0 end + case when regexp_matches(text, '(?i)\b(?:method|approach|framework)\b') then 4 else 0 end + case when regexp_matches(text, '(?i)\b(?:experiment|result|evaluation)\b') then 3 else 0 end
 + case when regexp_matches(text, '(?i)\b(?:conclusion|limitation|discussion)\b') then 3 else 0 end as int) score from r)
select *, cast(row_number() over (partition by source order by score desc, doc_id) as int) place from s qualify place <= 6""",
    "document_edge_furniture": rf"""with {_PRINTED}, w as (select source, doc_id, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') w from pages),
f as (select source, doc_id, len(w) n, list_transform(w, lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) w from w),
e as (select source, doc_id, n, 'start' edge, w[1:16] x from f union all select source, doc_id, n, 'end', list_reverse(w)[1:16] from f),
r as (select source, doc_id, edge, k, array_to_string(x[1:k], ' ') run from e, (select unnest(range(2, 17)) k) where k < n),
c as (select source, edge, k, run, count(*) pages, min(doc_id) f from r group by all), l as (select source, greatest(3, ceil(count(*) * 0.3)) least_ from pages group by 1)
select source, edge, run, pages from c join l using (source) where pages >= least_ qualify row_number() over (partition by source, edge order by pages desc, k desc, f) = 1""",
    "order_bibtex": r"""with r as (select o_orderkey k, 'Ü {' || substr(o_orderpriority, 3) || '} {study}\ of ' || c_name title, c_name || ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) author, cast(year(o_orderdate) as varchar) y, c_mktsegment s, o_orderpriority p from orders join customer on o_custkey = c_custkey),
b as (select *, substr(case when k % 6 <> 0 then lower(s) else 'paper' end || case when k % 7 <> 0 then y else 'nd' end || lower(regexp_replace(string_split(substr(p, 3), ' ')[case when length(regexp_replace(string_split(substr(p, 3), ' ')[1], '[^A-Za-z0-9]', '', 'g')) > 2 then 1 else 2 end], '[^A-Za-z0-9]', '', 'g')), 1, 72) base from r),
n as (select *, base || case when row_number() over (partition by base order by k) > 1 then '-' || k else '' end key from b)
select k o_orderkey, key citation_key, '@article{' || key || ',' || chr(10) || '  title = {' || replace(replace(replace(title, '\', '\\'), '{', '\{'), '}', '\}') || '}' || case when k % 6 <> 0 then ',' || chr(10) || '  author = {' || author || ' and Bo Li}' else '' end
 || case when k % 7 <> 0 then ',' || chr(10) || '  year = {' || y || '}' else '' end || case when k % 2 = 0 then ',' || chr(10) || '  journal = {Venue ' || s || '}' else '' end || case when k % 3 = 0 then ',' || chr(10) || '  doi = {10.1/' || k || '}' else '' end
 || case when k % 5 = 0 then ',' || chr(10) || '  eprint = {2401.00001},' || chr(10) || '  archivePrefix = {arXiv}' else '' end || case when k % 4 = 0 then ',' || chr(10) || '  keywords = {a, b}' else '' end || chr(10) || '}' entry from n""",
    "document_keyword_entries": r"""with l as (select doc_id, string_split('- **alpha**: first letter' || chr(10) || '1) **beta :** second **one**' || chr(10) || ' * **gamma** – third ' || chr(10) || '- delta: no' || chr(10) || '+ **:** no' || chr(10) || text, chr(10)) l from documents where text is not null),
u as (select doc_id, unnest(l) t, unnest(range(len(l))) line from l),
e as (select doc_id, line, regexp_extract(t, '^\s*(?:[-*+]|\d+[.)])\s+\*\*([^*]+?)\s*(?:[:：]\s*\*\*|\*\*\s*[:：—–-])\s*(.+?)\s*$', ['term', 'definition']) e from u)
select doc_id, cast(line as int) line, trim(e.term) term, trim(e.definition) definition from e where trim(e.term) <> '' and trim(e.definition) <> ''""",
    "benchmark_question_parts": rf"""with p as (select item_id, text, list_filter(list_transform(string_split_regex(text, '(?i)\?|,|;|\band\b|\band\s+also\b|및|그리고'), lambda x: trim(x)), lambda x: length(x) >= 3) p, regexp_extract_all({_FLAT}, '[\p{{L}}\p{{N}}]{{2,}}') w from benchmark where text is not null),
f as (select *, flatten(list_transform(range(1, len(w) + 1), lambda i: list_concat(case when regexp_matches(w[i], '[A-Za-z]') and length(w[i]) >= 4 then [w[i]] else [] end, case when i < len(w) and length(w[i]) >= 3 and length(w[i + 1]) >= 3 then [w[i] || ' ' || w[i + 1]] else [] end))) f from p),
a as (select item_id, list_filter(list_concat(list_concat([trim(text)], p), f), lambda x: length(x) >= 3) a from f), u as (select item_id, unnest(a) t, unnest(range(len(a))) n from a), g as (select item_id, t, min(n) n from u group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by n) - 1 as int) part, t "text" from g qualify part < 24""",
    "conversation_memory_relevance": rf"""with q as (select item_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(case when item_id % 9 = 0 then '' else text end), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')), lambda x: length(x) >= 3 and not list_contains({_ASKS}, x)) t from benchmark)
select conv_id, turn, item_id, cast(case when len(t) = 0 then 1 else 2 * len(list_filter(t, lambda x: contains(lower(coalesce(text, '')), x))) end as int) score from conversations join q on conv_id % 40 = item_id % 40""",
}
ORACLES["document_first_pages"] = rf"""with parts as ({ORACLES["benchmark_question_parts"]}), a as (select item_id, part, {_FLAT} t from parts), d as (select doc_id, {_FLAT} t from documents where text is not null)
select item_id, part, min(doc_id) page, count(*) pages from a join d on contains(d.t, a.t) where a.t <> '' group by 1, 2"""
