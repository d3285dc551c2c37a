"""Registered queries of text and entity rules, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.functions import text as X
from folioscope.sources.tables import table


def document_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring_index("text", "\n", 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("title"))
    return rows.select("doc_id", F.length(E.letters_only(F.col("title"))).alias("plain"), F.substring(E.title_key(F.col("title")), 1, 80).alias("key"))


def document_title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one title key of twelve characters or more are candidates of one entity."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(E.title_key(F.substring_index("text", "\n", 1)), 1, 60).alias("key"))
    groups = rows.where(F.length("key") >= 12).groupBy("key").agg(F.count("*").alias("records"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return groups.where("records > 1").select("first", "last", "records")


def benchmark_title_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that share a word, by Dice similarity; the best other title of each."""
    words = table(spark, sf_dir, "benchmark").select("item_id", E.title_words(F.col("text")).alias("words"))
    each = words.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = each.select(F.col("item_id").alias("other"), F.col("n").alias("m"), "word")
    shared = each.join(other, "word").where("item_id <> other").groupBy("item_id", "other", "n", "m").agg(F.count("*").alias("shared"))
    scored = shared.select("item_id", "other", F.round(2 * F.col("shared") / (F.col("n") + F.col("m")), 6).alias("dice"))
    order = Window.partitionBy("item_id").orderBy(F.desc("dice"), "other")
    return scored.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def benchmark_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(E.query_terms(F.col("text")), " ").alias("terms"))


def order_doi_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("https://doi.org/", "doi: ", "DOI:", "http://dx.doi.org/", "see "))), (k % 5 + 1).cast("int")), F.lit("10.1234/ABC."), k.cast("string"), F.when(k % 3 == 0, ".").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.doi(raw).alias("doi"))


def order_arxiv_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lit("07."), F.lpad((k % 100000).cast("string"), 5, "0"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("arXiv:"), number, F.lit("v2"))).when(k % 4 == 1, F.concat(F.lit("https://arxiv.org/abs/"), number)).when(k % 4 == 2, F.concat(F.lit("10.48550/arXiv."), number)).otherwise(F.concat(F.lit("no "), number))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.arxiv_id(raw).alias("arxiv"))


def customer_flipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(", ", "c_name", "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).otherwise(F.concat_ws(",", "c_name", F.lit("x"), F.lit("y")))
    return table(spark, sf_dir, "customer").select("c_custkey", E.flipped_name(raw).alias("name"))


def customer_citation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' citations of customers: same id, or segments as titles with a nation's key for the author and a digit for the year."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    titles = E.dice(E.title_words(F.concat_ws(" ", F.lit("model"), "c_mktsegment", "o_orderpriority")), E.title_words(F.concat_ws(" ", F.lit("model of the"), "c_mktsegment", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))))
    score = E.citation_score(F.col("o_orderkey") % 17 == 0, titles, F.col("c_nationkey") % 3 == 0, F.col("o_orderkey") % 3 == 0)
    return joined.select("o_orderkey", score.alias("score"))


def document_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(E.token_estimate(F.col("text"))).alias("tokens"))


def order_field_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later time, longer text, larger number: how two records of one entity are merged."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flag = F.concat(F.col("flag"), F.lit("-returned"))
    return joined.select("o_orderkey", E.later(F.col("o_orderdate"), F.col("shipped")).alias("seen"), E.longer(F.col("o_orderpriority"), flag).alias("text"), F.greatest(F.lit(25.0), "quantity").alias("count"))


def page_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that mean one page are one; the first row of each stays."""
    rows = table(spark, sf_dir, "pages").select("page_id", E.url_key(F.concat("url", F.when(F.col("page_id") % 2 == 0, "#top").otherwise(""))).alias("key"))
    return rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))


def document_anchor_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.anchor_segments(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("segments"), F.length(F.array_join("s", "")).alias("chars"))


def part_table_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of a column of cells by header and unit: units are labels and never compared with each other; the first wins ties."""
    rows = table(spark, sf_dir, "part")
    cell = F.concat(F.format_number(F.round("p_retailprice", -2), 0), F.element_at(F.array(*map(F.lit, ("", "%", "K"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    value, unit = X.number_cell(cell)
    cells = rows.select("p_brand", unit.alias("unit"), value.alias("number"), "p_partkey").where("number is not null")
    out = cells.groupBy("p_brand", "unit").agg(
        F.count("*").alias("cells"), F.max("number").alias("largest"), F.max_by("p_partkey", F.struct("number", -F.col("p_partkey"))).alias("largest_at"),
        F.min("number").alias("smallest"), F.min_by("p_partkey", F.struct("number", "p_partkey")).alias("smallest_at"),
    )
    return out.where("cells >= 2")


def event_vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length, and their product with the next one of the same label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("vec_id", "label", "v", norm.alias("norm")).select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    after = F.lead("v").over(Window.partitionBy("label").orderBy("vec_id"))
    return unit.withColumn("w", after).select("vec_id", F.round(F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("product"))


def order_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine bounds, share of overlap with the next box, and orientation, of boxes that the lines of an order make."""
    lines = table(spark, sf_dir, "lineitem")
    x, y, w, h = F.col("l_quantity") * 4, F.col("l_extendedprice") / 100, F.col("l_quantity") + 20, F.col("l_tax") * 500 + 30
    boxes = lines.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), (x + w).alias("r"), (y + h).alias("b"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "x", "y")
    near = boxes.select("*", *(F.lead(c).over(order).alias(f"n{c}") for c in ("x", "y", "r", "b")))
    wide, high = F.greatest(F.least("r", "nr") - F.greatest("x", "nx"), F.lit(0.0)), F.greatest(F.least("b", "nb") - F.greatest("y", "ny"), F.lit(0.0))
    share = F.when(F.col("nx").isNotNull(), F.round(wide * high / ((F.col("r") - F.col("x")) * (F.col("b") - F.col("y"))), 6))
    angle = F.round(F.pmod(F.degrees(F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x"))), F.lit(360.0)), 4)
    return near.groupBy("l_orderkey").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("r").alias("right"), F.max("b").alias("bottom"), F.round(F.sum(share), 4).alias("overlap"), F.sum((angle >= 180).cast("int")).alias("turned"))


def event_axis_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a logarithmic and on a linear axis, and on a circle."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    ends = rows.agg(F.max("value").alias("most"))
    angle = 2 * F.pi() * (F.col("event_id") % 12) / 12
    return rows.crossJoin(ends).select("event_id", F.round(F.log1p("value") / F.log1p("most"), 6).alias("log_place"), F.round(F.col("value") / F.col("most"), 6).alias("linear_place"), F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y"))


def event_local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by calendar day; those without a time last, under no day."""
    time = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


def event_json_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects are equal whatever the order of their keys; an unknown key counts as absent."""
    rows = table(spark, sf_dir, "events")
    a = F.concat(F.lit('{"b":'), F.floor("value").cast("string"), F.lit(',"a":"x"}'))
    b = F.concat(F.lit('{"a":"x","c":null,"b":'), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    parsed = lambda c: F.from_json(c, "a string, b long, c string")
    return rows.where("value is not null").select("event_id", parsed(a).eqNullSafe(parsed(b)).alias("equal"))


QUERIES = {
    f.__name__: f
    for f in (
        document_title_keys, document_title_duplicates, benchmark_title_dice, benchmark_query_terms, order_doi_forms, order_arxiv_forms, customer_flipped_names, customer_citation_identity,
        document_token_estimate, order_field_merges, page_url_keys, document_anchor_segments, 
        part_table_extrema, event_vector_units, order_geometry, event_axis_scale, event_local_days, event_json_equality,
    )
}

_STOP = "['" + "','".join(E.TITLE_STOP_WORDS) + "']"
_ASKS = "['" + "','".join(E.QUERY_STOP_WORDS) + "']"
_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(string_split({}, ' ')), lambda w: length(w) > 1 and not list_contains(" + _STOP + ", w))"
_HEAD = "split_part(text, chr(10), 1)"
_NUMBER = r"^\s*([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([%KMB]?)\s*$"


def _words_of(text: str) -> str:
    return _WORDS.format(_PLAIN.format(text))


ORACLES = {
    "document_title_keys": rf"select doc_id, cast(length({_PLAIN.format(_HEAD)}) as int) plain, substr(regexp_replace(lower({_HEAD}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 80) as \"key\" from documents".replace("\\\"", '"'),
    "document_title_duplicates": rf"""with t as (select doc_id, substr(regexp_replace(lower({_HEAD}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 60) k from documents)
select min(doc_id) "first", max(doc_id) "last", count(*) records from t where length(k) >= 12 group by k having count(*) > 1""",
    "benchmark_title_dice": f"""with w as (select item_id, {_words_of('text')} words from benchmark),
e as (select item_id, len(words) n, unnest(words) word from w),
s as (select a.item_id, b.item_id other, a.n, b.n m, count(*) shared from e a join e b using (word) where a.item_id <> b.item_id group by all),
r as (select item_id, other, round(2 * shared / (n + m), 6) dice from s), t as (select *, row_number() over (partition by item_id order by dice desc, other) t from r)
select item_id, other, dice from t where t = 1""",
    "benchmark_query_terms": f"""select item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(w, lambda x: length(x) >= 3 and not list_contains({_ASKS}, x))), lambda x: {{'at': list_position(w, x), 'w': x}})), lambda x: x.w), ' ') terms
from (select item_id, string_split({_PLAIN.format('text')}, ' ') w from benchmark)""",
    "order_doi_forms": "select o_orderkey, case when o_orderkey % 5 <> 4 then '10.1234/abc.' || o_orderkey end doi from orders",
    "order_arxiv_forms": "select o_orderkey, case when o_orderkey % 4 <> 3 then lpad(cast(o_orderkey % 100 as varchar), 2, '0') || '07.' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0') end arxiv from orders",
    "customer_flipped_names": "select c_custkey, case c_custkey % 3 when 0 then c_mktsegment || ' ' || c_name when 1 then c_name else c_name || ',x,y' end \"name\" from customer",
    "customer_citation_identity": f"""with j as (select o_orderkey k, c_nationkey n, {_words_of("concat_ws(' ', 'model', c_mktsegment, o_orderpriority)")} a, {_words_of("concat_ws(' ', 'model of the', c_mktsegment, case when o_orderkey % 2 = 0 then o_orderpriority end)")} b from orders join customer on o_custkey = c_custkey),
d as (select k, n, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) d from j),
s as (select k, case when k % 17 = 0 then 1.0 when d >= 0.72 then round(d * 0.75 + case when n % 3 = 0 then 0.15 else 0.0 end + case when k % 3 = 0 then 0.10 else 0.0 end, 9) end s from d)
select k o_orderkey, case when s >= 0.78 then cast(s as double) end score from s""",
    "document_token_estimate": "select source, cast(sum(greatest(1, cast(ceil(length(coalesce(text, '')) / 2.0) as int))) as bigint) tokens from documents group by 1",
    "order_field_merges": """with l as (select l_orderkey, max(l_shipdate) shipped, max(l_returnflag) || '-returned' flag, max(l_quantity) quantity from lineitem group by 1)
select o_orderkey, greatest(o_orderdate, shipped) seen, case when flag is null or length(o_orderpriority) >= length(flag) then o_orderpriority else flag end "text", greatest(25.0, quantity) "count" from orders left join l on l_orderkey = o_orderkey""",
    "page_url_keys": r"""with u as (select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://(?:www\.)?', '') u from pages), v as (select page_id, regexp_replace(regexp_replace(regexp_replace(u, '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/+$', '') u from u)
select lower(split_part(u, '/', 1)) || substr(u, length(split_part(u, '/', 1)) + 1) "key", min(page_id) "first", count(*) pages from v group by 1""",
    "document_anchor_segments": r"""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: length(x) >= 12) s from documents)
select doc_id, cast(len(s) as int) segments, cast(length(array_to_string(s, '')) as int) chars from s""",
    "part_table_extrema": """with c as (select p_brand, ['', '%', 'K'][cast(p_partkey % 3 + 1 as int)] unit, round(p_retailprice, -2) n, p_partkey k from part)
select p_brand, unit, count(*) cells, max(n) largest, (list(k order by n desc, k))[1] largest_at, min(n) smallest, (list(k order by n, k))[1] smallest_at from c group by 1, 2 having count(*) >= 2""",
    "event_vector_units": """with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) n from v),
w as (select vec_id, v, n, lead(v) over p w, lead(n) over p m from u window p as (partition by label order by vec_id)) select vec_id, round(list_dot_product(v, w) / (n * m), 6) product from w""",
    "order_geometry": """with b as (select l_orderkey, l_linenumber, l_quantity * 4 x, l_extendedprice / 100 y, l_quantity * 4 + (l_quantity + 20) r, l_extendedprice / 100 + (l_tax * 500 + 30) b from lineitem),
n as (select *, lead(x) over p nx, lead(y) over p ny, lead(r) over p nr, lead(b) over p nb from b window p as (partition by l_orderkey order by l_linenumber, x, y)),
s as (select *, case when nx is not null then round(greatest(least(r, nr) - greatest(x, nx), 0.0) * greatest(least(b, nb) - greatest(y, ny), 0.0) / ((r - x) * (b - y)), 6) end sh,
 case when nx is not null then degrees(atan2(ny - y, nx - x)) end an from n)
select l_orderkey, min(x) "left", min(y) top, max(r) "right", max(b) bottom, round(sum(sh), 4) overlap, sum(case when an < 0 or an >= 180 then 1 when an >= 0 then 0 end) turned from s group by 1""",
    "event_axis_scale": """select event_id, round(ln(1 + value) / ln(1 + m), 6) log_place, round(value / m, 6) linear_place, round(cos(2 * pi() * (event_id % 12) / 12), 6) x, round(sin(2 * pi() * (event_id % 12) / 12), 6) y from events, (select max(value) m from events) where value is not null""",
    "event_local_days": "select case when event_id % 9 <> 0 then strftime(ts, '%Y-%m-%d') end \"day\", count(*) events, min(event_id) \"first\" from events group by 1",
    "event_json_equality": "select event_id, cast(floor(value) as bigint) = event_id % 100 \"equal\" from events where value is not null",
}
