"""Registered queries of exchange formats and page rules, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import interchange as I
from folioscope.functions import text as X
from folioscope.sources import imports
from folioscope.sources.tables import table


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written with front matter and read again; every fifth is broken on purpose."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    note = I.front_matter(F.concat_ws("-", "conv_id", "turn"), F.array("role"), F.lit("2024-01-01"), F.col("text"))
    broken = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("---\n{oops\n---\n"), F.col("text"))).when(F.col("turn") % 5 == 4, F.col("text")).otherwise(note)
    head, body, fault = I.parsed_front_matter(broken)
    return rows.select("conv_id", "turn", head["title"].alias("title"), F.array_join(head["tags"], ",").alias("tags"), F.length(body).alias("chars"), fault.alias("fault"))


def event_experiment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of one experiment file: malformed ones, records that do not fit, repeated runs, and keys that must not travel."""
    k = F.col("event_id")
    config = F.when(k % 13 == 0, F.struct(F.lit("x").alias("api_key"), F.lit(None).cast("int").alias("max_tokens"), F.lit(None).cast("string").alias("note"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("api_key"), (k % 9).cast("int").alias("max_tokens"), F.when(k % 19 == 0, F.concat(F.lit("Bearer "), F.repeat(F.lit("a"), 20))).alias("note"))
    )
    record = F.struct(
        F.when(k % 17 == 0, "other").otherwise("experiment-v1").alias("format"), F.concat(F.lit("run"), F.floor(k / 2).cast("string")).alias("runId"), F.lit("A run").alias("title"), F.lit("completed").alias("status"),
        F.col("event_type").alias("task"), F.lit("m").alias("model"), config.alias("aggregateConfig"), F.struct("value").alias("aggregateMetrics"),
    )
    text = F.when(k % 11 == 0, "{broken").otherwise(F.to_json(record))
    # Dealt first: the table is small for what is done with a row, and would be left to few tasks.
    events = table(spark, sf_dir, "events").where("value is not null").select("event_id", "event_type", "value").repartition("event_id")
    lines = events.select(F.lit("events").alias("file"), k.alias("line"), text.alias("text"))
    out = imports.experiments(lines)
    return out.select(F.col("line").alias("event_id"), "error", F.array_join("sensitive", ",").alias("sensitive"))


def conversation_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without local paths, and their settings without keys that must not travel."""
    raw = F.concat(F.lit("see /home/ann/notes.txt, `/tmp/x y` and /etc/hosts "), F.coalesce("text", F.lit("")))
    raw = F.when(F.col("turn") % 2 == 0, raw).otherwise(F.col("role"))
    meta = F.create_map(F.lit("Api-Key"), F.lit("x"), F.lit("author"), F.lit("y"), F.lit("where"), F.lit("at /Users/ann/z\""), F.lit("role"), F.col("role"))
    clean = I.sanitised(meta)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(clean)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    text = I.redacted(raw)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(text, 1, 60).alias("begins"), (~text.eqNullSafe(raw)).alias("hidden"), shown.alias("settings"))


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of a feed, read again."""
    entry = I.atom_entry(F.col("p_partkey").cast("string"), F.concat(F.col("p_name"), F.lit(" & <co>")), F.col("p_brand"), F.concat((2000 + F.col("p_size") % 20).cast("string"), F.lit("-01-02")))
    # Dealt first: the table is small for what is done with a row, and would be left to few tasks.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition("p_partkey")
    return parts.select("p_partkey", I.parsed_atom_entry(entry).alias("x")).select("p_partkey", "x.*")


def part_provider_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers' records as one kind of paper; those without a title go."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    year, doi = 2000 + F.col("p_size") % 20, F.concat(F.lit("10.1/P"), F.col("p_partkey").cast("string"))
    struct = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in c.items())))
    scholar = struct(title=name, authors=F.array(F.struct(brand.alias("name"))), year=year, externalIds=F.struct(doi.alias("DOI")))
    crossref = struct(title=F.array(name), author=F.array(F.struct(brand.alias("given"), F.col("p_type").alias("family"))), DOI=doi, issued=F.struct(F.array(F.array(year)).alias("date-parts")))
    openalex = struct(display_name=name, publication_year=year, doi=F.concat(F.lit("https://doi.org/"), doi), authorships=F.array(F.struct(F.struct(brand.alias("display_name")).alias("author"))))
    raw = F.when(k % 4 == 0, scholar).when(k % 4 == 1, crossref).when(k % 4 == 2, openalex).otherwise(F.lit('{"year": 2000}'))
    papers = table(spark, sf_dir, "part").select("p_partkey", I.uniform_paper(raw).alias("x")).where("x is not null")
    return papers.select("p_partkey", "x.title", F.array_join("x.authors", ";").alias("authors"), "x.year", "x.doi")


def order_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board for each customer: its orders as nodes, and lines to those that share a day's priority among them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    other = orders.select(F.col("o_custkey").alias("board"), F.col("o_orderkey").alias("to"), F.col("o_orderpriority").alias("kind"))
    edges = orders.join(other, (F.col("o_custkey") == F.col("board")) & (F.col("o_orderpriority") == F.col("kind")) & (F.col("o_orderkey") < F.col("to"))).groupBy("o_custkey").agg(F.count("*").alias("edges"))
    nodes = orders.groupBy("o_custkey").agg(F.count("*").alias("nodes"), F.min("o_orderkey").alias("first"))
    return nodes.join(edges, "o_custkey", "left").select("o_custkey", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "first")


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup's manifest: bytes and digests of every entry, to be checked against what is restored."""
    own = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    manifest = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(own).alias("bytes"), F.sha2(own, 256).alias("digest"))
    restored = F.encode(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 50 == 7, " ").otherwise("")), "UTF-8")
    again = table(spark, sf_dir, "documents").where("doc_id % 50 <> 9").select("doc_id", F.sha2(restored, 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("digest"), "damaged").otherwise("intact")
    return manifest.join(again, "doc_id", "left").select("doc_id", "bytes", state.alias("state"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and metadata of a page's head."""
    at = lambda pattern: F.nullif(F.trim(F.regexp_extract("html", pattern, 1)), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        at(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))).alias("links"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<(?:p|li|h[1-6])\b"), F.lit(0))).alias("blocks"),
    )


def document_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by what they look like: headings, figures, tables, equations, list items, and the rest."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("source", F.explode(F.split("text", "\n")).alias("line"))
    # The patterns in the order in which they are tried.
    kinds = (
        ("figure", r"(?i)^\s*fig(?:ure)?\.?\s*[0-9]+"), ("table", r"(?i)^\s*table\s*[0-9]+"), ("heading", r"^\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s+[A-Z]|#+\s)"),
        ("item", r"^\s*(?:[-*]|[0-9]+[.)])\s+"), ("equation", r"^[^A-Za-z]*=[^A-Za-z]*$"), ("blank", r"^\s*$"),
    )
    kind = F.lit("text")
    for name, pattern in reversed(kinds):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    return lines.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("lines"))


def document_citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that bracketed marks of a text cite, and whether its list of lines has them: resolved, or not."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" [3, 5-7] [2] [9999]")).alias("t"), F.size(F.split("text", "\n")).alias("entries"))
    marks = rows.select("doc_id", "entries", F.explode(F.regexp_extract_all("t", F.lit(r"\[([0-9]{1,4}(?:\s*[,-]\s*[0-9]{1,4})*)\]"), F.lit(1))).alias("mark"))
    cited = marks.select("doc_id", "entries", F.explode(X.expanded_numbers(F.col("mark")).cast("array<int>")).alias("number")).distinct()
    state = F.when(F.col("number").between(1, F.col("entries")), "resolved").otherwise("unresolved")
    return cited.groupBy("doc_id").agg(F.count("*").alias("cited"), F.count_if(state == "resolved").alias("resolved"))


def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki links of notes, with their label where they have one."""
    raw = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[Note "), F.col("conv_id").cast("string"), F.lit("|label]] and [["), F.col("role"), F.lit("]]"))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(raw, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("link"))
    return found.select("conv_id", "turn", F.trim(F.substring_index("link", "|", 1)).alias("target"), F.when(F.col("link").contains("|"), F.substring_index("link", "|", -1)).alias("label"))


def lineitem_carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order with the heading before it: the last one of a flag R."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    heading = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.last(heading, ignorenulls=True).over(order).alias("under"))
    return rows.groupBy("l_orderkey").agg(F.count("under").alias("headed"), F.max("under").alias("last_heading"))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_notes, event_experiment_lines, conversation_redacted, part_feed, part_provider_papers, order_canvas, document_manifest, page_meta,
        document_line_classes, document_citation_marks, conversation_links, lineitem_carried_headings,
    )
}

_MARKS = r"regexp_extract_all(text || ' [3, 5-7] [2] [9999]', '\[([0-9]{1,4}(?:\s*[,-]\s*[0-9]{1,4})*)\]', 1)"

ORACLES = {
    "conversation_notes": """select conv_id, turn, case when turn % 5 < 3 then conv_id || '-' || turn end title, case when turn % 5 < 3 then role end tags, cast(length(coalesce(text, '')) as int) chars, case turn % 5 when 3 then 'malformed' when 4 then 'missing' end fault from conversations""",
    "event_experiment_lines": """with l as (select event_id k, event_id // 2 run, case when event_id % 11 = 0 then 'malformed JSON' when event_id % 17 = 0 then 'format' end wrong from events where value is not null),
f as (select run, min(k) f from l where wrong is null group by 1)
select k event_id, coalesce(wrong, case when k > f then 'repeated run' end) error, case when k % 11 = 0 then '' when k % 13 = 0 then 'aggregateConfig.api_key' when k % 19 = 0 then 'aggregateConfig.note' else '' end "sensitive" from l left join f using (run)""",
    "conversation_redacted": """select conv_id, turn, substr(case when turn % 2 = 0 then 'see [redacted-path] `[redacted-path] y` and /etc/hosts ' || coalesce(text, '') else role end, 1, 60) begins, turn % 2 = 0 hidden, 'role=' || role || ';where=at [redacted-path]"' settings from conversations""",
    "part_feed": """select p_partkey, cast(p_partkey as varchar) id, p_name || ' & <co>' title, p_brand author, 2000 + p_size % 20 "year" from part""",
    "part_provider_papers": """select p_partkey, p_name title, case when p_partkey % 4 = 1 then p_brand || ' ' || p_type else p_brand end authors, 2000 + p_size % 20 "year", '10.1/p' || p_partkey doi from part where p_partkey % 4 <> 3""",
    "order_canvas": """with e as (select a.o_custkey k, count(*) n from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.o_orderkey < b.o_orderkey group by 1)
select o_custkey, count(*) nodes, coalesce(any_value(n), 0) edges, min(o_orderkey) "first" from orders left join e on k = o_custkey group by 1""",
    "document_manifest": """select doc_id, cast(strlen(coalesce(text, '')) as int) bytes, case when doc_id % 50 = 9 then 'missing' when doc_id % 50 = 7 then 'damaged' else 'intact' end state from documents""",
    "page_meta": r"""select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') title, cast(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) as int) links, cast(len(regexp_extract_all(html, '(?i)<(?:p|li|h[1-6])\b')) as int) blocks from pages""",
    "document_line_classes": r"""with l as (select source, unnest(string_split(text, chr(10))) line from documents where text is not null)
select source, case when regexp_matches(line, '(?i)^\s*fig(?:ure)?\.?\s*[0-9]+') then 'figure' when regexp_matches(line, '(?i)^\s*table\s*[0-9]+') then 'table' when regexp_matches(line, '^\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s+[A-Z]|#+\s)') then 'heading'
 when regexp_matches(line, '^\s*(?:[-*]|[0-9]+[.)])\s+') then 'item' when regexp_matches(line, '^[^A-Za-z]*=[^A-Za-z]*$') then 'equation' when regexp_matches(line, '^\s*$') then 'blank' else 'text' end kind, count(*) "lines" from l group by 1, 2""",
    "document_citation_marks": rf"""with m as (select doc_id, len(string_split(text, chr(10))) entries, unnest({_MARKS}) mark from documents where text is not null),
p as (select doc_id, entries, string_split(trim(x), '-') e from (select doc_id, entries, unnest(string_split(mark, ',')) x from m)),
r as (select doc_id, entries, cast(trim(e[1]) as int) a, cast(trim(coalesce(e[2], e[1])) as int) b from p),
n as (select distinct doc_id, entries, unnest(case when b >= a and b - a <= 100 then range(a, b + 1) else [] end) num from r)
select doc_id, count(*) cited, count(*) filter (num between 1 and entries) resolved from n group by 1""",
    "conversation_links": r"""with l as (select conv_id, turn, unnest(regexp_extract_all(coalesce(text, '') || ' [[Note ' || conv_id || '|label]] and [[' || role || ']]', '\[\[([^\]\n]+)\]\]', 1)) link from conversations)
select conv_id, turn, trim(split_part(link, '|', 1)) target, case when contains(link, '|') then split_part(link, '|', -1) end as "label" from l""",
    "lineitem_carried_headings": """with u as (select l_orderkey, last_value(case when l_returnflag = 'R' then l_linenumber end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag rows between unbounded preceding and current row) u from lineitem)
select l_orderkey, count(u) headed, max(u) last_heading from u group by 1""",
}
