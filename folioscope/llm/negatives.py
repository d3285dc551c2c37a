"""Hard-negative mining by a secondary sort.

1. Rows are dealt round-robin into blocks of a bounded size and written. Anchors, in
   parts, meet every block; a block gives an anchor's best rows of its label, and the
   best of all blocks are its positives.
2. Anchors meet every block again, now with the windows that their positives open (scores
   between two shares of a positive's); a block gives the first rows of other labels in
   each window. More than these no block can add to the result.
3. Positives and negatives are packed into keys of anchor, descending score, id whose
   bytes sort as their fields do, and go through one repartitionAndSortWithinPartitions by
   anchor. A task streams its keys: a positive opens a window, a negative is emitted for
   each open window that it falls in, a window closes when it is full or passed. What is
   held is an anchor's open windows, never its rows.

Rows take part that have an id, a label and a vector without null or non-finite components
(scaled, floored and held within 2**62). "Other rows" are all but the anchor's own row:
rows that repeat an id are rows each, as anchors, positives and negatives. Vectors meet
those of equal length. A positive of negative score has an empty window, one of score 0 the
negatives of score 0. Scores beyond a long are held at its ends. An empty table, or one
without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.blobs import pack, unpack
from folioscope.llm.common import cut, named, written
from folioscope.llm.topk import quantised
from folioscope.llm.vectors import as_long, products, sound

#: Rows of a block, and of the smallest block that is made to give every core one.
BLOCK_ROWS, LEAST_ROWS = 8192, 1024
POSITIVE, NEGATIVE = 0, 1

BLOCKS = "block int, dim int, start int, ids binary, labels binary, vectors binary, asks binary"
_ASKED = "row long, anchor_id long, label int, q array<long>"
FOUND = "row long, anchor_id long, score long, id long"

#: A key: anchor id, anchor row, descending score, kind, id; big-endian with the sign turned, so that bytes sort as numbers.
_KEY = ">QQQBQ"
_KEYS = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = 1 << 63


def _packed(anchor: int, row: int, score: int, kind: int, id_: int) -> bytes:
    return struct.pack(_KEY, anchor + _SIGN, row + _SIGN, _SIGN - 1 - score, kind, id_ + _SIGN)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a block: a row for each length of its vectors, sorted by id."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table, block = pa.Table.from_batches(parts), TaskContext.get().partitionId()
    sizes, start = np.asarray(table["q"].combine_chunks().value_lengths()), 0
    for dim in np.unique(sizes).tolist():
        own = table.filter(pa.array(sizes == dim)).sort_by("id").combine_chunks()
        values = own["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, labels, asks = (own[c].to_numpy() for c in ("id", "label", "ask"))
        row = [[block], [dim], [start], [pack(ids.astype(np.int64))], [pack(labels.astype(np.int32))], [pack(values)], [pack(asks.astype(np.uint8))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (*[pa.int32()] * 3, *[pa.binary()] * 4))], names=[c.split()[0] for c in BLOCKS.split(", ")])
        start += own.num_rows


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks; a row number is block and place."""
    for batch in batches:
        for r in batch.to_pylist():
            at = np.flatnonzero(unpack(r["asks"], np.uint8))
            if not len(at):
                continue
            dim, x = r["dim"], unpack(r["vectors"], np.int64)
            q = x.reshape(-1, dim)[at] if dim else np.empty((len(at), 0), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * dim, pa.array(q.ravel()))
            columns = [pa.array([r["block"]] * len(at), pa.int32()), pa.array([dim] * len(at), pa.int32()), pa.array((np.int64(r["block"]) << 32) + r["start"] + at), pa.array(unpack(r["ids"], np.int64)[at]), pa.array(unpack(r["labels"], np.int32)[at]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "dim", "row", "anchor_id", "label", "q"])


def _meet(blocks: DataFrame, asked: DataFrame, number: int, each) -> DataFrame:
    """``each`` of every block with every part of the anchors: a block is sent once, the parts follow it."""
    parts = asked.groupBy("part", "dim").agg(F.collect_list(F.struct("row", "anchor_id", "label", "q", "windows")).alias("anchors"))
    copies = parts.select(F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block"), F.lit(1).alias("step"), "dim", "anchors")
    sent = blocks.select("block", F.lit(0).alias("step"), "dim", "start", "ids", "labels", "vectors")
    met = sent.unionByName(copies, allowMissingColumns=True).repartitionById(number, F.col("block")).sortWithinPartitions("block", "step", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                now, step, dim = (batch.column(c)[k].as_py() for c in ("block", "step", "dim"))
                if now != block:
                    block, held = now, {}
                if step == 0:
                    ids, labels = (unpack(batch.column(c)[k].as_py(), t) for c, t in (("ids", np.int64), ("labels", np.int32)))
                    x = unpack(batch.column("vectors")[k].as_py(), np.int64).reshape(len(ids), dim)
                    held[dim] = ids, labels, batch.column("start")[k].as_py(), x
                elif dim in held:
                    anchors = batch.column("anchors")[k].values
                    field = lambda name, own=anchors: own.field(name)
                    q = np.asarray(field("q").flatten()).astype(np.int64).reshape(len(anchors), dim)
                    rows, own_ids, own_labels = (np.asarray(field(c)) for c in ("row", "anchor_id", "label"))
                    yield from each(block, *held[dim][:3], rows, own_ids, own_labels, field("windows"), products(q, held[dim][3]))

    return met.mapInArrow(run, each.schema)


class _Best:
    """The best rows of an anchor's own label in a block."""

    schema = FOUND

    def __init__(self, most: int):
        self.most = most

    def __call__(self, block, ids, labels, start, rows, own_ids, own_labels, windows, scores):
        out = []
        for row, own, label, s in zip(rows.tolist(), own_ids.tolist(), own_labels.tolist(), scores):
            fit = labels == label
            if row >> 32 == block:
                fit[(row & 0xFFFFFFFF) - start] = False
            at = np.flatnonzero(fit)
            at = at[np.argsort(-s[at], kind="stable")[: self.most]]  # rows stand by id
            out.append((np.full(len(at), row), np.full(len(at), own), as_long(s[at]), ids[at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["row", "anchor_id", "score", "id"])


class _Windows:
    """The first rows of other labels in each window of an anchor, as keys."""

    schema = "key binary"

    def __init__(self, most: int, low: int, high: int):
        self.most, self.low, self.high = most, low, high

    def __call__(self, block, ids, labels, start, rows, own_ids, own_labels, windows, scores):
        out = []
        for row, own, label, s, opened in zip(rows.tolist(), own_ids.tolist(), own_labels.tolist(), scores, windows.to_pylist()):
            bounds = [(-(-self.low * p // 100), self.high * p // 100) for p in opened if p >= 0]  # whole scores within
            if not bounds:
                continue
            at = np.flatnonzero((labels != label) & (s >= min(b for b, _ in bounds)) & (s <= max(b for _, b in bounds)))
            at = at[np.argsort(-s[at], kind="stable")]
            down = -s[at]
            taken = np.zeros(len(at), bool)
            for a, b in bounds:
                begin, end = np.searchsorted(down, -b, "left"), np.searchsorted(down, -a, "right")
                taken[begin : min(end, begin + self.most)] = True
            at = at[taken]
            keys = np.empty(len(at), _KEYS)
            keys["anchor"], keys["row"], keys["kind"] = own + _SIGN, row + _SIGN, NEGATIVE
            keys["score"] = ~(as_long(s[at]).view(np.uint64) ^ np.uint64(_SIGN))
            keys["id"] = ids[at].view(np.uint64) ^ np.uint64(_SIGN)
            out.append(keys.tobytes())
        if out:
            data = b"".join(out)
            ends = np.arange(0, len(data) + 1, _KEYS.itemsize, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])], names=["key"])


def _streamed(most: int, low: int, high: int):
    """Result rows of a task's sorted keys."""

    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        own, windows = None, []
        for key, _ in keys:
            anchor, row, score, kind, id_ = struct.unpack(_KEY, key)
            anchor, score, id_ = anchor - _SIGN, _SIGN - 1 - score, id_ - _SIGN
            if (anchor, row) != own:
                own, windows = (anchor, row), []
            if kind == POSITIVE:
                windows.append([id_, score, 0])
                continue
            for window in windows:
                if low * window[1] <= 100 * score <= high * window[1]:
                    window[2] += 1
                    yield anchor, window[0], window[2], id_, window[1], score
            windows = [w for w in windows if w[2] < most and 100 * score >= low * w[1]]

    return run


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; for each, its negatives
    are the first rows of other labels whose score is ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, then smaller ids.
    """
    spark, vector = df.sparkSession, named(vector_col)
    fit = sound(vector) & named(id_col).isNotNull() & named(label_col).isNotNull()
    rows = df.where(fit).select(
        named(id_col).cast("long").alias("id"), named(label_col).cast("int").alias("label"), quantised(vector, scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("ask")
    )
    count = rows.count()
    number = max(1, -(-count // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, count // LEAST_ROWS))
    blocks = written(rows.repartition(number).mapInArrow(_blocks, BLOCKS))
    anchors = blocks.mapInArrow(_anchors, f"part int, dim int, {_ASKED}")
    none = F.array().cast("array<long>")
    found = _meet(blocks, anchors.withColumn("windows", none), number, _Best(positives))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    chosen = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).drop("place"))
    opened = chosen.groupBy("row").agg(F.collect_set("score").alias("windows"))
    met = _meet(blocks, anchors.join(opened, "row"), number, _Windows(negatives, low, high))
    near = met.rdd.map(lambda r: (bytes(r.key), None))
    far = chosen.rdd.map(lambda r: (_packed(r.anchor_id, r.row, r.score, POSITIVE, r.id), None))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = spark.sparkContext.union([near, far]).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(dealt.mapPartitions(_streamed(negatives, low, high)), schema, verifySchema=False)
