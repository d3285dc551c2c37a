"""Exact top-k by integer inner product over a bit-sliced index.

Each attribute of a vector is quantised to floor(scale * x) and kept as bit
slices: one bitmap over the rows of a block for each binary digit. A query's
scores for all rows of a block are the sum of its attributes' slices, shifted by
the digits of the query's own attributes and added as bitmaps with carry-save
adders. The best rows are then selected from the most significant slice of the
sum downward; rows that tie at the boundary are resolved exactly, by smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Vectors are compared with those of equal length (empty ones
score 0 with each other). Rows that repeat an id are rows each: no query meets rows of its
own id, and queries of one id share one ranking.
Quantised attributes are held within 2**62 and scores within a long. An empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, named

#: Rows in a block, and queries handled together.
BLOCK_ROWS, QUERY_ROWS = 1 << 16, 128
MOST = 1 << 62

INDEX = "dim int, block int, rows int, ids binary, low binary, width binary, slices binary, queries binary, query_ids binary"


def quantised(vector: Column, scale: int) -> Column:
    within = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST)))
    return F.transform(vector, lambda x: F.floor(within(F.lit(float(scale)) * x.cast("double"))))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of the last axis, as 64-bit words."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), np.uint8)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def _unpack(words: np.ndarray, rows: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), count=rows, bitorder="little"))


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, is_query: Column | None = None) -> DataFrame:
    """One row for each block of at most about BLOCK_ROWS vectors: ids, per-attribute minimum and digits, slices, and the block's queries."""
    vector = named(vector_col)
    fit = vector.isNotNull() & named(id_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(fit).select(
        named(id_col).cast("long").alias("id"),
        quantised(vector, scale).alias("q"),
        (F.lit(False) if is_query is None else F.coalesce(is_query, F.lit(False))).alias("ask"),
    )
    blocks = max(1, -(-rows.count() * 5 // (4 * BLOCK_ROWS)))  # hashed blocks are a little uneven

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy(np.int64)
        x = np.array(pdf["q"].tolist(), np.int64).reshape(len(ids), dim)
        ask = pdf["ask"].to_numpy(bool)
        low = x.min(axis=0) if dim else np.empty(0, np.int64)
        over = (x - low).view(np.uint64)  # at most 2**63
        width = np.array([int(v).bit_length() for v in over.max(axis=0)] if dim else [], np.int64)
        slices = [_pack(((over[:, j][None, :] >> np.arange(width[j], dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)) for j in range(dim)]
        packed = np.concatenate([np.empty((0, -(-len(ids) // 64)), np.uint64), *slices])
        return pd.DataFrame([[dim, int(key[1]), len(ids), ids.tobytes(), low.tobytes(), width.tobytes(), packed.tobytes(), x[ask].tobytes(), ids[ask].tobytes()]], columns=[c.split()[0] for c in INDEX.split(", ")])

    dealt = rows.withColumn("dim", F.size("q")).withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(build, INDEX)


def _added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Digits of the sum of bitmaps, where columns[p] holds those of weight 2**p: three become two until one is left."""
    out: list[np.ndarray] = []
    p = 0
    while p < len(columns):
        stack = columns[p]
        while len(stack) > 1:
            carry_to = columns[p + 1] if p + 1 < len(columns) else None
            if carry_to is None:
                columns.append(carry_to := [])
            if len(stack) > 2:
                a, b, c = stack.pop(), stack.pop(), stack.pop()
                ab = a ^ b
                stack.insert(0, ab ^ c)
                carry_to.append((a & b) | (ab & c))
            else:
                a, b = stack.pop(), stack.pop()
                stack.insert(0, a ^ b)
                carry_to.append(a & b)
        out.append(stack[0] if stack else None)
        p += 1
    return out


def _best(query: np.ndarray, own: int, ids: np.ndarray, low: np.ndarray, width: np.ndarray, slices: list[np.ndarray], everyone: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows of one block."""
    rows, words = len(ids), everyone
    columns: list[list[np.ndarray]] = [[]]
    constant = 0
    for j, weight in enumerate(query.tolist()):
        constant += weight * int(low[j])
        if not weight or not len(slices[j]):
            continue
        digits = slices[j]
        if weight < 0:  # -|w| * u is |w| * (all ones - u) less a constant
            constant += weight * ((1 << int(width[j])) - 1)
            digits, weight = ~digits, -weight
        for t in range(weight.bit_length()):
            if weight >> t & 1:
                while len(columns) < t + len(digits):
                    columns.append([])
                for s in range(len(digits)):
                    columns[s + t].append(digits[s])
    total = _added(columns)
    equal, sure = words.copy(), np.zeros_like(words)
    at, end = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    if end > at:
        mine = np.zeros(rows, np.uint8)
        mine[at:end] = 1
        equal &= ~_pack(mine)
    count = 0
    for digit in reversed(total):
        if digit is None:
            continue
        ones = equal & digit
        n = int(np.bitwise_count(ones).sum())
        if count + n > k:
            equal = ones
        else:
            sure |= ones
            count += n
            equal &= ~digit
    boundary = _unpack(equal, rows)[: max(0, k - count)]  # rows stand by id: the smaller ids win the tie
    chosen = np.concatenate([_unpack(sure, rows), boundary])
    # Beyond 62 digits in whole numbers of any size.
    large = len(total) > 62 or abs(constant) >= MOST
    score = np.full(len(chosen), constant, object if large else np.int64)
    for p, digit in enumerate(total):
        if digit is not None:
            ones = ((digit[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            score += (ones.astype(object) if large else ones) * (1 << p)
    return chosen, np.clip(score, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(index: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query of the index.

    The query set, in parts, goes to every block of rows; a block's slices stay together
    and are sent once (as often as there are shares, where blocks are fewer than cores).
    What leaves a block is k rows a query, and Spark ranks those partially before they
    are exchanged.
    """
    index = cut(index)
    asked = index.where(F.length("query_ids") > 0)
    last = F.floor((F.length("query_ids") / 8 - 1) / QUERY_ROWS).cast("int")
    asked = asked.select("dim", F.col("block").alias("source"), "queries", "query_ids", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    asked = asked.select(
        "dim",
        "source",
        "part",
        F.substring("queries", F.col("part") * QUERY_ROWS * F.col("dim") * 8 + 1, F.lit(QUERY_ROWS) * F.col("dim") * 8).alias("queries"),
        F.substring("query_ids", F.col("part") * QUERY_ROWS * 8 + 1, F.lit(QUERY_ROWS * 8)).alias("query_ids"),
    )
    shares = max(1, -(-index.sparkSession.sparkContext.defaultParallelism // max(1, index.count())))
    asks = asked.join(F.broadcast(index.select("dim", "block")), "dim").select(  # a number for each block
       
        "dim", "block", F.pmod(F.xxhash64("source", "part"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("step"), "queries", "query_ids"
    )
    blocks = index.select(
        "dim", "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("step"), "rows", "ids", "low", "width", "slices"
    )
    met = blocks.unionByName(asks, allowMissingColumns=True).repartition("dim", "block", "share").sortWithinPartitions("dim", "block", "share", "step")

    def best(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.step == 0:
                    rows = int(r.rows)
                    ids, low, width = (np.frombuffer(x, np.int64) for x in (r.ids, r.low, r.width))
                    packed = np.frombuffer(r.slices, np.uint64).reshape(int(width.sum()), -(-rows // 64))
                    ends = np.cumsum([0, *width])
                    slices = [packed[a:b] for a, b in zip(ends, ends[1:])]
                    everyone = _pack(np.ones(rows, np.uint8))
                    continue
                own = np.frombuffer(r.query_ids, np.int64)
                for query_id, query in zip(own.tolist(), np.frombuffer(r.queries, np.int64).reshape(len(own), r.dim)):
                    chosen, score = _best(query, query_id, ids, low, width, slices, everyone, k)
                    yield pd.DataFrame({"query_id": query_id, "vec_id": ids[chosen], "score": score})

    found = met.mapInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
