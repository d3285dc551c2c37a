"""Registered queries of page layout: an order's lines stand for what is on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import layout, pages, sentences
from folioscope.sources.tables import table

WIDTH = 600.0


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line of an order; those with equal numbers are one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("q"))
    x = F.when(F.col("l_partkey") % 2 == 0, 20.0).otherwise(320.0)
    width = F.when(F.col("l_partkey") % 5 == 0, 500.0).otherwise(240.0)
    y = (F.col("l_partkey") % 97).cast("double") * 8
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "q", x.alias("x"), y.alias("y"), width.alias("width"))


def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("x", F.col("x") + F.col("l_linenumber") / 100)
    return layout.reading_order(boxes, ["l_orderkey"], WIDTH).select("l_orderkey", "l_linenumber", "place")


def page_item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _boxes(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("ord"), "x", (F.col("y") % 40).alias("y"), (F.col("width") / 4).alias("width"), F.lit(12.0).alias("height"))
    return layout.lines_of_items(items, "l_orderkey").select("l_orderkey", "ord", "line")


def page_heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("level"))
    return layout.heading_parents(headings, "l_orderkey", "l_linenumber", "level")


def page_nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "q", "x", "y", (F.col("x") + F.col("width")).alias("r"), (F.col("y") + 10 + F.col("q")).alias("b"))
    visuals = boxes.where("q >= 40").withColumn("b", F.col("b") + 200)
    return layout.nested_blocks(boxes.where("q < 40"), visuals, "l_orderkey", "l_linenumber")


def page_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("b", F.col("y") + 10 + F.col("q"))
    captions = boxes.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("caption"), "y")
    return layout.nearest_captions(captions, boxes.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("visual"), "x", "y", "b"), "l_orderkey")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("level"))
    return layout.open_sections(headings, "l_orderkey", "l_linenumber", "level", 99)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a page of ten orders: a number, text or equation each."""
    k = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("q"))
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.select(F.floor(F.col("l_orderkey") / 10).alias("page"), item.alias("item"), (k % 53 * 11).cast("double").alias("x"), (k % 41 * 9).cast("double").alias("y"), (F.col("q") * 2).alias("width"), (k % 3 * 6 + 10).cast("double").alias("height"), k.alias("k"))


def page_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.source_lines(_placed(spark, sf_dir), ["page"], "item", WIDTH)[1]


def page_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose middle is in the frame that every fifth item of a page opens to the right and below."""
    items = _placed(spark, sf_dir)
    frames = items.where("k % 5 = 0").select("page", F.col("item").alias("container"), "x", "y", (F.col("width") + 150).alias("width"), (F.col("height") + 90).alias("height"))
    return pages.inside(items.withColumnRenamed("item", "box"), frames, "page")


def page_equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _placed(spark, sf_dir)
    equations = items.where("k % 4 = 0").withColumnRenamed("item", "equation")
    content = F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).otherwise(F.concat(F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return pages.equation_numbers(equations, items.where("k % 4 <> 0").withColumn("content", content), "page", WIDTH)


def document_sentence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph, a line of the text, that each sentence of a document starts in; sentences run over lines."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    said = docs.select("doc_id", F.posexplode(sentences.sentences(F.regexp_replace("text", r"\s*\n\s*", " "))).alias("turn", "text")).withColumn("block", F.lit("b"))
    held = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return pages.aligned_sentences(said, held, "doc_id")


def order_reused_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as units of a page: some are as they were, some under another number, some new."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    n = F.col("l_linenumber")
    source = F.concat(F.lit("Part  ["), F.col("k").cast("string"), F.lit("](http://x)"))
    units = lines.select("l_orderkey", n.alias("unit"), F.when(F.col("k") % 7 == 0, F.concat(source, F.lit("!"))).otherwise(source).alias("source"))
    cached = lines.select("l_orderkey", n.alias("turn"), F.when(F.col("k") % 5 == 0, n + 100).otherwise(n).alias("unit"), F.concat(F.lit("Part "), F.col("k").cast("string")).alias("source"), F.when(F.col("k") % 11 == 0, " translation ").otherwise(F.concat(F.lit("Teil "), "k")).alias("translation"))
    told, complete = pages.reused_translations(units, cached, "l_orderkey")
    return told.join(complete, "l_orderkey")


QUERIES = {f.__name__: f for f in (page_reading_order, page_item_lines, page_heading_parents, page_nested_blocks, page_captions, page_sections, page_source_lines, page_inside, page_equation_numbers, document_sentence_paragraphs, order_reused_translations)}

_BOX = """g as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, max(l_quantity) q from lineitem group by 1, 2),
box as (select l_orderkey, l_linenumber, l_partkey, q, case when l_partkey % 2 = 0 then 20.0 else 320.0 end x, cast(l_partkey % 97 as double) * 8 y, case when l_partkey % 5 = 0 then 500.0 else 240.0 end width from g)"""

_PLACED = """g as (select l_orderkey, l_linenumber, min(l_partkey) k, max(l_quantity) q from lineitem group by 1, 2),
item as (select l_orderkey // 10 page, l_orderkey * 10 + l_linenumber item, cast(k % 53 * 11 as double) x, cast(k % 41 * 9 as double) y, q * 2 width, cast(k % 3 * 6 + 10 as double) height, k from g)"""

ORACLES = {
    "page_source_lines": f"""with {_PLACED}, b as (select *, lag(x + width) over w pr, lag(y) over w py, lag(height) over w ph from item window w as (partition by page order by y, x, item)),
o as (select *, case when abs(y - py) <= greatest(height, ph) * 0.75 and greatest(0.0, x - pr) <= 150 then 0 else 1 end o from b),
l as (select *, cast(sum(o) over (partition by page order by y, x, item) - 1 as int) line from o)
select page, line, count(*) items, min(x) x, min(y) y, max(x + width) - min(x) width, max(y + height) - min(y) height from l group by 1, 2""",
    "page_inside": f"""with {_PLACED} select c.page, c.item container, b.item box from item c join item b using (page) where c.k % 5 = 0 and b.x + b.width / 2 between c.x and c.x + c.width + 150 and b.y + b.height / 2 between c.y and c.y + c.height + 90""",
    "page_equation_numbers": f"""with {_PLACED}, n as (select page, '(' || k || ')' t, x, y + height / 2 m from item where k % 4 <> 0 and k % 3 <> 0)
select e.page, e.item equation, min_by(t, (n.x, t)) "number" from item e join n on e.page = n.page where e.k % 4 = 0 and n.x >= e.x + e.width and n.x - (e.x + e.width) <= 150 and abs(n.m - e.y - e.height / 2) <= e.height group by 1, 2""",
    "order_reused_translations": """with g as (select l_orderkey, l_linenumber n, min(l_partkey) k from lineitem group by 1, 2), c as (select l_orderkey, n turn, case when k % 5 = 0 then n + 100 else n end unit, 'Part ' || k s, case when k % 11 <> 0 then 'Teil ' || k end t from g),
u as (select l_orderkey, n unit, 'Part ' || k || case when k % 7 = 0 then '!' else '' end s from g),
b as (select u.*, c.s = u.s same, c.t own, (select min_by(d.t, d.turn) from c d where d.l_orderkey = u.l_orderkey and d.s = u.s and d.t is not null) other from u left join c on c.l_orderkey = u.l_orderkey and c.unit = u.unit),
f as (select l_orderkey, unit, coalesce(same, false) same, coalesce(case when same then own end, other) translation from b)
select l_orderkey, unit, translation, bool_and(same) over w and count(translation) over w = count(*) over w complete from f window w as (partition by l_orderkey) qualify translation is not null""",
    "page_reading_order": f"""with {_BOX}, s as (select *, x + l_linenumber / 100 xx, case when width >= 432 then 1 else 0 end s from box),
b as (select *, 2 * sum(s) over (partition by l_orderkey order by y, xx) - s band, case when s = 1 then 0 when xx >= 300 then 1 else 0 end col from s)
select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by band, col, y, xx) as int) place from b""",
    "page_heading_parents": f"""with {_BOX}, h as (select l_orderkey, l_linenumber, cast(l_partkey % 4 as int) as "level" from box)
select a.l_orderkey, a.l_linenumber, a."level", max(b.l_linenumber) parent from h a left join h b on a.l_orderkey = b.l_orderkey and b.l_linenumber < a.l_linenumber and b."level" < a."level"
 and not exists (select 1 from h c where c.l_orderkey = a.l_orderkey and c.l_linenumber > b.l_linenumber and c.l_linenumber < a.l_linenumber and c."level" <= b."level") group by 1, 2, 3""",
    "page_nested_blocks": f"""with {_BOX}, e as (select *, x + width r, y + 10 + q b from box), v as (select l_orderkey, x, y, r, b + 200 b from e where q >= 40)
select distinct e.l_orderkey, e.l_linenumber from e join v using (l_orderkey) where q < 40 and greatest(least(e.r, v.r) - greatest(e.x, v.x), 0) * greatest(least(e.b, v.b) - greatest(e.y, v.y), 0) >= 0.5 * (e.r - e.x) * (e.b - e.y)""",
    "page_captions": f"""with {_BOX}, e as (select *, y + 10 + q b from box),
d as (select c.l_orderkey, c.l_linenumber caption, v.l_linenumber visual, v.x, greatest(v.y - c.y, c.y - v.b, 0.0) distance from e c join e v on c.l_orderkey = v.l_orderkey and c.l_linenumber % 2 = 0 and v.l_linenumber % 2 = 1),
r as (select *, row_number() over (partition by l_orderkey, caption order by distance, x, visual) t from d) select l_orderkey, caption, visual, distance from r where t = 1""",
    "page_sections": f"""with {_BOX}, h as (select l_orderkey, l_linenumber, cast(l_partkey % 4 as int) as "level" from box)
select a.l_orderkey, a.l_linenumber, a."level", coalesce(min(b.l_linenumber) - 1, 99) ends from h a left join h b on a.l_orderkey = b.l_orderkey and b.l_linenumber > a.l_linenumber and b."level" <= a."level" group by 1, 2, 3""",
}
