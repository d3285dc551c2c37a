"""Benchmark decontamination: containment search with size-partitioned MinHash.

A test item is contained in a document if at least ``containment`` of its shingles
of ``width`` words occur there. Documents are partitioned by size into powers of two.
Within a partition whose documents have up to u shingles, documents and items get a
one-permutation MinHash of 4 * u bins (the high bits of a shingle's hash are its bin,
the smallest hash of a bin is its value): a document as large as that hardly ever
hides an item's value behind one of its own, so that one common value makes a
candidate. Items of very few shingles, where a hidden value could matter, have all
their shingles looked up in a table of their own; an item of fewer words than
``width`` is one shingle, its whole sequence, looked up among the runs of as many
words. Candidates are verified by exact containment of shingles, whose 64-bit hashes
stand for them.

Words are runs of letters and digits, lowered. Empty and null texts, and those without
words, contain nothing and are contained in nothing. Documents are told apart by id,
and rows that repeat one count as one document with the words of each; rows with a
null id are not reported, nor are items with a null id. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh, let, named

#: Item shingles up to which their table is broadcast (about 40 bytes each); beyond, Spark joins by shuffle.
BROADCAST_SHINGLES = 500_000
#: Candidates (id and item, some 50 bytes each) up to which their ids are broadcast; beyond, Spark joins by shuffle.
BROADCAST_HITS = 500_000
#: Items of fewer shingles are looked up by every one of them.
FEW = 8
SIZES = range(3, 34)


def _words(text: Column) -> Column:
    """Hashes of the words, in their order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Sorted distinct hashes of the shingles (empty without any)."""

    def of(own: Column) -> Column:
        starts = F.when(F.size(own) >= width, F.sequence(F.lit(1), F.size(own) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(own, i + k - 1) for k in range(width))))

    return F.sort_array(F.array_distinct(let(words, of)))


def _item_shingles(words: Column, width: int) -> Column:
    """Like `_shingles`, but the whole sequence as one where it is shorter."""
    whole = lambda own: F.when(F.size(own).between(1, width - 1), F.array(_run(own, F.lit(0), F.size(own))))
    return let(words, lambda own: F.coalesce(whole(own), _shingles(own, width)))


def _run(words: Column, start: Column, size: Column) -> Column:
    """Hash of a run of fewer words than a shingle has, with its length."""
    return F.xxhash64(size, F.array_join(F.transform(F.slice(words, start + 1, size), lambda w: w.cast("string")), " "))


def _runs(words: Column, sizes: list[int]) -> Column:
    """Distinct hashes of all runs of the given lengths."""

    def of(own: Column) -> Column:
        starts = lambda n: F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n)).otherwise(F.array().cast("array<int>"))
        at = lambda n: lambda i: _run(own, i, F.lit(n))
        return F.concat(*(F.transform(starts(n), at(n)) for n in sizes))

    return F.array_distinct(let(words, of))


def _class(n: Column) -> Column:
    """Size partition: the least p with n <= 2**p."""
    return F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))), F.lit(SIZES[0])).cast("int")


def _minima(hashes: Column, p: Column) -> Column:
    """The smallest hash of each of the 2**(p + 2) bins that has one."""
    bits = F.lit(62) - p
    shift = lambda h: F.call_function("shiftright", h, bits)
    return let(hashes, lambda own: F.filter(own, lambda h, i: (i == 0) | (shift(h) != shift(F.get(own, i - 1)))))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, containment: float = 0.8) -> DataFrame:
    """(id, item, n_item, n_shared) of every document and item contained in it."""
    asked = items.where(named(item_col).isNotNull()).select(named(item_col).alias("item"), _words(named(item_text_col)).alias("w"))
    asked = asked.select("item", F.least(F.size("w"), F.lit(width)).alias("words"), _item_shingles(F.col("w"), width).alias("s"))
    asked = cut(asked.where(F.size("s") > 0).select("item", "words", "s", F.size("s").alias("n_item")))
    sized = docs.where(named(id_col).isNotNull()).select(named(id_col).alias("id"), _words(named(text_col)).alias("w"))
    sized = sized.select("id", "w", _shingles(F.col("w"), width).alias("s")).withColumn("p", _class(F.size("s")))
    # Rows that repeat an id are as large as the words of all of them may be.
    again = docs.where(named(id_col).isNotNull()).select(named(id_col).alias("id"), F.length(named(text_col)).alias("chars"))
    again = cut(again.groupBy("id").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars")).where("rows > 1").select("id", _class(F.col("chars")).alias("all")))
    if not again.isEmpty():
        sized = sized.join(again, "id", "left").withColumn("p", F.greatest("p", "all")).drop("all")

    shingles = asked.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    short = sorted(r.words for r in asked.where(F.col("words") < width).select("words").distinct().collect())  # lengths below width
    small = shingles * len(SIZES) <= BROADCAST_SHINGLES
    fit = lambda table: F.broadcast(table) if small else table

    full = asked.where(F.col("words") == width)
    classes = full.where(F.col("n_item") >= FEW).select("item", "n_item", "s", F.explode(F.array(*map(F.lit, SIZES))).alias("p"))
    # A partition whose largest documents are too small for the item holds none of it.
    classes = classes.where(F.pow(F.lit(2.0), F.col("p")) >= containment * F.col("n_item"))
    lookup = classes.select("item", F.col("p").alias("vp"), F.explode(_minima(F.col("s"), F.col("p"))).alias("v"))
    values = sized.where(F.size("s") > 0).select("id", "p", F.explode(_minima(F.col("s"), F.col("p"))).alias("value"))
    hits = values.join(fit(lookup), (F.col("p") == F.col("vp")) & (F.col("value") == F.col("v"))).select("id", "item")
    few = full.where(F.col("n_item") < FEW)
    if not few.isEmpty():
        all_ = sized.select("id", F.explode("s").alias("value"))
        hits = hits.union(all_.join(fit(few.select("item", F.explode("s").alias("v"))), F.col("value") == F.col("v")).select("id", "item"))
    if short:
        runs = sized.select("id", F.explode(_runs(F.col("w"), short)).alias("value"))
        whole = asked.where(F.col("words") < width).select("item", F.explode("s").alias("v"))
        hits = hits.union(runs.join(fit(whole), F.col("value") == F.col("v")).select("id", "item"))
    hits = cut(hits.distinct())

    # Exact containment of the candidates.
    named_docs = docs.where(named(id_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).alias("t"))
    wanted = hits.groupBy("id").agg(F.collect_set("item").alias("items"))  # at most the items, a bounded table
    wanted = F.broadcast(wanted) if hits.count() <= BROADCAST_HITS else wanted
    texts = named_docs.join(wanted, "id").select("id", _words(F.col("t")).alias("w"), "items")
    both = _shingles(F.col("w"), width)
    if short:
        both = F.concat(both, _runs(F.col("w"), short))
    pairs = texts.select("id", both.alias("s"), F.explode("items").alias("item"))
    pairs = pairs.join(fit(asked.select("item", "n_item", F.col("s").alias("asked"))), "item")
    pairs = pairs.select("id", "item", "n_item", F.array_intersect("asked", "s").alias("common"))
    shared = pairs.groupBy("id", "item", "n_item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("common")))).alias("n_shared"))
    return shared.where(F.col("n_shared") >= containment * F.col("n_item")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null id stay."""
    (own,) = fresh(docs, "hit")
    hit = contained_items(docs, items, id_col=id_col, **options).select(named(id_col).alias(own)).distinct()
    return docs.join(hit, named(id_col) == named(own), "left_anti")
