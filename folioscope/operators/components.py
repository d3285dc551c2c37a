"""Joins that survive hot keys, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.shared import cut

#: A key is hot from this share of the rows on (so there are 1000 at most), and from so many rows.
HOT_SHARE, HOT_ROWS = 1000, 100_000


def hot_keys(counts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of a table (key, n), a bounded number; None if there are none."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(hot_rows, (total or 0) / HOT_SHARE)
    if (most or 0) < least:
        return None
    return cut(counts.where((F.col("n") >= least) & F.col(key).isNotNull()).select(key))


def looked_up(rows: DataFrame, by: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``by``, which has one row for each key (inner join).

    Hot keys, a bounded number, are looked up in a broadcast table; all others are joined, and
    none of them is large. The keys are counted first: where ``rows`` are dear, cut them before.
    """
    return _met(rows, by, key, hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, hot_rows))


def looked_up_counted(rows: DataFrame, by: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``by``, as above; ``by`` tells in ``n`` how many rows a key has, so that they need not be counted."""
    return _met(rows, by.drop("n"), key, hot_keys(by, key, hot_rows))


def _met(rows: DataFrame, by: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return rows.join(by, key)
    few = F.broadcast(by.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(by, key))


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b), which are long: the smallest node that can be reached.

    Every node's larger neighbours are hung on its smallest one, then its smaller ones
    are, in turn, until nothing moves: then each component is a star. A turn deals the edges
    twice and streams them in order; nodes with very many edges are looked up instead.
    Loops, nulls and repeated edges do no harm; a node without an edge to another does not appear.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    before = None
    while True:
        total, sum_, most = links.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if (total, sum_) == before or not total:
            break
        before = total, sum_
        both = links.union(links.select("b", "a"))
        if most < max(hot_rows, total / HOT_SHARE):
            links = cut(_streamed(_streamed(both, _larger), _smaller))
            continue
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = looked_up(both.where("b > a"), least, "a", hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(hung.where("a <> b").distinct())
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        met = looked_up(links, least, "a", hot_rows)
        hung = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = cut(hung.where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _larger(a: np.ndarray, b: np.ndarray, m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The larger neighbours of each node, under its smallest one or itself."""
    up = b > a
    return b[up], np.minimum(a, m)[up]


def _smaller(a: np.ndarray, b: np.ndarray, m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller neighbours of each node, and the node in place of the smallest, under that."""
    return np.where(first, a, b), m


def _streamed(links: DataFrame, hang: Callable) -> DataFrame:
    """Links (a, b) that ``hang`` makes of the different links of each node, which come with its smallest neighbour and whether they are the link to that; a node takes time but no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            if not len(a):
                continue
            la, lb, lm = last or (a[0] - 1, b[0], b[0])
            first = a != np.concatenate([[la], a[:-1]])
            new = first | (b != np.concatenate([[lb], b[:-1]]))
            # The smallest neighbour comes first; a node that goes on from the last batch keeps it.
            start = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
            m = np.where(start < 0, lm, b[start])
            last = a[-1], b[-1], m[-1]
            own, top = hang(a[new], b[new], m[new], first[new])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(top, pa.int64())], names=["a", "b"])

    return links.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")
