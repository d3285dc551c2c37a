"""Line dedup by a log-template tree of fixed depth.

Lines are masked (a token with a digit becomes a wildcard) and descend a tree: by
their token count, then by their leading tokens. In a leaf, tokens that most of its
lines have in a place are constant and the rest are variable fields; where the
constants are most of the line, the lines that fit them are one template. A leaf is
parted by a token at a further place until its other lines have a template or nothing
in common; those are templates of their own. A template that occurs in two documents or more stays in the first of them (by
id) and is dropped from the others; short lines that differ need three documents.

Lines without a letter outside their wildcards take no part: they stay, as empty lines
do. Null texts stay null; empty tables give no rows. Documents are told apart by id and
text: rows that repeat both are one document here and all get its result; a null id
sorts first. All columns of ``df`` pass through.

Texts are masked once: what is counted, joined and dropped are hashes and places of
lines, in a table. Only where a leaf holds several lines are these read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh, let, named, written

WILD = "<*>"
LEADING = 3
#: Below so many tokens the leading ones alone nearly make a template: two lines that differ are none, three documents are needed.
SHORT = 8
#: Rows up to which a table of leaves or lines is broadcast (some 50 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000
LEAST_ID = -(1 << 63)


def _mask(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ 0-9]*+[0-9][^ ]*+", WILD)).otherwise(line)


def _flat(line: Column) -> Column:
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\f", "\x0b"):
        odd |= line.contains(blank)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " "))).otherwise(F.trim(line))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _document(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(named(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(named(text_col)).alias("th")]


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, h1, h2, size, leaf): places of lines, hashes of the masked line, its tokens and its leaf of the tree (their count and the leading ones)."""
    out = df.select(*_document(df, id_col, text_col), F.posexplode(F.split(named(text_col), "\n", -1)).alias("pos", "raw"))
    out = out.where(F.col("raw") != "").select("id", "th", "pos", _flat(F.col("raw")).alias("flat"))
    out = out.select("id", "th", "pos", _mask(F.col("flat")).alias("line")).where(F.col("line").rlike(r"\p{L}"))
    out = out.withColumn("size", _tokens(F.col("line")))
    leaf = F.xxhash64("size", F.substring_index("line", " ", LEADING))
    return out.select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "size", leaf.alias("leaf"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _grouped(held: DataFrame, min_docs: int, constant_share: float, majority: float) -> DataFrame:
    """(h1, h2, group, docs, lo, hi, size): the lines of ``held`` that fit the constants of their group.

    Lines that do not fit are parted by their token at one place, and their groups tried
    anew, but for those that differ from the constants in few places. Constants of one template occur equally often, so the place is one of those of
    the count that most places have, and there the one whose frequent tokens cover most
    lines; tokens too rare there stay together. No place parts
    a line twice.
    """
    tokens, out = F.split("line", " "), None
    while True:
        # The leading tokens are those of the leaf: the largest count is that of the group.
        seen = held.select("group", "docs", F.posexplode(tokens).alias("place", "token")).groupBy("group", "place", "token").agg(F.sum("docs").alias("docs"))
        counts = seen.groupBy("group", "docs", "place").agg(F.sum((F.col("token") != WILD).cast("int")).alias("kinds"), F.max("token").alias("token"))
        sizes = counts.groupBy("group").agg(F.max("docs").alias("all"))
        # More than half: one token of a place at most, and the only one with its count.
        counts = counts.join(sizes, "group")
        constants = counts.where((F.col("docs") > majority * F.col("all")) & (F.col("kinds") > 0)).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("constants"))
        apart = counts.where((F.col("docs") < F.col("all")) & (F.col("docs") >= min_docs) & (F.col("kinds") > 0))
        place = Window.partitionBy("group", "place")
        apart = apart.withColumn("cover", F.sum(F.col("docs") * F.col("kinds")).over(place)).withColumn("few", -F.sum("kinds").over(place))
        apart = apart.groupBy("group", "docs").agg(F.count("*").alias("places"), F.max(F.struct("cover", "few", "place")).alias("at"))
        apart = apart.groupBy("group").agg(F.max(F.struct("places", "docs", "at")).alias("best")).select("group", F.col("best.at.place").alias("at"))
        info = cut(constants.join(apart, "group", "full"))
        fits = (F.size("constants") >= constant_share * F.size(tokens)) & let(tokens, lambda own: F.forall("constants", lambda c: F.get(own, c["place"]) == c["token"]))
        tried = held.join(info, "group").withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("token", F.get(tokens, F.col("at")))
        fit = cut(tried.where("fits").select("h1", "h2", "group", "docs", "lo", "hi", F.size(tokens).alias("size")))
        out = fit if out is None else out.union(fit)
        often = tried.where("at is not null").groupBy("group", "token").agg(F.sum("docs").alias("often")).where(F.col("often") >= min_docs)
        # A line that has most of the constants is of this template but for a few words, which makes it none of another.
        agree = F.coalesce(let(tokens, lambda own: F.size(F.filter("constants", lambda c: F.get(own, c["place"]) == c["token"]))), F.lit(0))
        left = tried.where(~F.col("fits") & F.col("at").isNotNull() & (agree < constant_share * F.size(tokens))).join(often, ["group", "token"], "left")
        part = F.xxhash64("group", "at", F.when(F.col("often").isNotNull(), F.col("token")))
        left = cut(left.select("h1", "h2", part.alias("group"), "docs", "lo", "hi", "line"))
        # A line is in a template of enough documents only if so many of its tokens may be constants there.
        places = left.select("h1", "h2", "group", "docs", F.size(tokens).alias("size"), F.posexplode(tokens).alias("place", "token")).where(F.col("token") != WILD)
        seen = places.groupBy("group", "place", "token").agg(F.sum("docs").alias("seen")).where(F.col("seen") > majority * min_docs)
        able = places.join(seen, ["group", "place", "token"]).groupBy("h1", "h2", "group").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        held = cut(left.join(able.where(F.col("n") >= constant_share * F.col("size")).select("h1", "h2", "group"), ["h1", "h2", "group"]))
        if held.isEmpty():
            return out


def _texts(df: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, group, docs, lo, hi, line) of lines that are known by place alone."""
    wanted = cut(places.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "h1", "h2", "group", "docs", "lo", "hi")).alias("own")))
    i, t = fresh(df, "ld_id", "ld_th")
    found = df.select(*(c.alias(n) for c, n in zip(_document(df, id_col, text_col), (i, t))), F.split(named(text_col), "\n", -1).alias("raw"))
    found = found.join(_few(wanted), (named(i) == F.col("id")) & (named(t) == F.col("th")))
    found = found.select("raw", F.explode("own").alias("own")).select("own.*", _flat(F.get("raw", F.col("own.pos"))).alias("flat"))
    found = found.select("h1", "h2", "group", "docs", "lo", "hi", _mask(F.col("flat")).alias("line"))
    return found.dropDuplicates(["h1", "h2", "group"])  # equal rows of the table give equal lines


def recurring_templates(df: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, constant_share: float = 0.6, majority: float = 0.5) -> DataFrame:
    """(h1, h2, first_id, first_th, template): hashes of the masked lines that belong to a recurring template, and its first document.

    ``lines`` are the places of all lines of ``df``.
    """
    # A document's repeats of a line are folded first, then a line's documents; both combine before they shuffle.
    key = F.struct("id", "th")
    each = lines.groupBy("h1", "h2", "size", "leaf", "id", "th").agg(F.min("pos").alias("pos"))
    whole = each.groupBy("h1", "h2", "size", F.col("leaf").alias("group"))
    whole = whole.agg(F.count("*").alias("docs"), F.min(F.struct("id", "th", "pos")).alias("at"), F.max(key).alias("hi"))
    whole = written(whole.select("h1", "h2", "size", "group", "docs", "at.id", "at.th", "at.pos", "hi"))
    leaves = whole.groupBy("group").agg(F.sum("docs").alias("all"), F.count("*").alias("n")).where((F.col("all") >= min_docs) & (F.col("n") > 1)).select("group")
    leaves = cut(leaves)
    places = whole.join(_few(leaves), "group").withColumn("lo", key)
    general = cut(_grouped(cut(_texts(df, places, id_col, text_col)), min_docs, constant_share, majority))
    # Up to 3 documents, first and last of each line and the largest line tell the number exactly.
    ends = general.withColumn("key", F.explode(F.array("lo", "hi")))
    if min_docs > 3:
        ends = each.select("h1", "h2", key.alias("key")).join(general, ["h1", "h2"])
    holders = ends.groupBy("group", "key").agg(F.max("docs").alias("docs"), F.min("size").alias("size"), F.min("h1").alias("one"), F.max("h1").alias("other"))
    found = holders.groupBy("group").agg(F.greatest(F.count("*"), F.max("docs")).alias("n"), F.min("key").alias("first"), F.min("size").alias("size"), (F.min("one") != F.max("other")).alias("several"))
    least = F.when(F.col("several") & (F.col("size") < SHORT), max(min_docs, 3)).otherwise(min_docs)
    found = cut(found.where(F.col("n") >= least).select("group", "first"))
    shared = general.join(_few(found), "group").select("h1", "h2", "first", F.concat(F.lit("group "), F.col("group").cast("string")).alias("template"))
    own = whole.where(F.col("docs") >= min_docs).join(shared, ["h1", "h2"], "left_anti").select("h1", "h2", key.alias("first"), F.concat(F.lit("line "), F.col("h1").cast("string")).alias("template"))
    return shared.union(own).select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"), "template")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "dropped_lines", **options) -> DataFrame:
    """``df`` without the lines of recurring templates (but in their first documents), and the number of lines dropped."""
    i, t, drop, dropped = fresh(df, "ld_id", "ld_th", "ld_drop", dropped_col)
    lines = written(_lines(df, id_col, text_col))
    recurring = recurring_templates(df, lines, id_col, text_col, **options).select("h1", "h2", "first_id", "first_th")
    out = lines.select("id", "th", "pos", "h1", "h2").join(recurring, ["h1", "h2"]).where((F.col("id") != F.col("first_id")) | (F.col("th") != F.col("first_th")))
    drops = out.groupBy(F.col("id").alias(i), F.col("th").alias(t)).agg(F.collect_set("pos").alias(drop))
    keyed = df.select(*map(named, df.columns), *(c.alias(n) for c, n in zip(_document(df, id_col, text_col), (i, t))))
    joined = keyed.join(drops, [i, t], "left")
    raw = F.split(named(text_col), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), named(drop))
    kept = let(raw, lambda own: F.array_join(F.transform(places, lambda k: F.get(own, k)), "\n"))
    has = named(drop).isNotNull()
    text = F.when(has, kept).otherwise(named(text_col)).alias(text_col)
    count = F.when(has, F.size(named(drop))).otherwise(F.lit(0)).alias(dropped)
    return joined.select(*(text if c == text_col else named(c) for c in df.columns), count)
