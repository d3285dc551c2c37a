"""Centroid clustering (Lloyd's rounds, in whole numbers) with heap-ordered bounds.

Vectors stand in blocks: what a task reads at a time becomes a block, nothing is
exchanged. In a block each cluster has a heap of its vectors, ordered by the gap between
the distances from the second nearest and the own centroid when the vector was last
scanned, plus the drift that the cluster had gathered by then. When centroids move, a
cluster's drift grows by its own move and the largest move of the others; a vector whose
key it reaches may have a nearer centroid. Only those are popped, scanned exactly against
all centroids and pushed again; the rest stay where they are unseen. Keys are lowered a
little against rounding, so that assignments are those of a full scan, ties included.

A round writes the blocks again, with the vectors' moves between clusters as sums by
cluster, which Spark adds up; the driver holds the ``k`` centroids, counts and sums. Each
table is removed when the next one stands.

Rows take part whose vector has exactly ``dim`` components, none null or non-finite; they
are scaled and floored (held within 2**62). Repeated rows are vectors each. Rows without an
id take part and come last among the seeds. Fewer rows than ``k`` give as many clusters as
rows, none gives no result. A cluster that has lost all vectors keeps its centroid.
Distances and inertias beyond a long are held at its end. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blobs import pack, unpack
from folioscope.llm.common import discard, kept, named
from folioscope.llm.topk import quantised
from folioscope.llm.vectors import LONG, as_long, distances, own_distances, sound

#: By how much keys are lowered and drifts raised against rounding, far above that of doubles.
SLACK = 1e-9

STATE_DDL = (
    "ids array<long>, vectors binary, sizes binary, keys binary, members binary, scanned long, "
    "clusters array<int>, counts array<long>, sums array<array<decimal(38,0)>>"
)
_NUMBER = pa.decimal128(38, 0)
STATE = pa.schema([
    ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("members", pa.binary()), ("scanned", pa.int64()),
    ("clusters", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(_NUMBER))),
])

Heap = list[tuple[float, int]]


@dataclass
class Clusters:
    """``assigned`` has id, cluster and distance; the rest is by cluster. ``scans`` counts the vectors scanned in each round."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertias: list[int]
    scans: list[int]


def _scanned(x: np.ndarray, members: np.ndarray, centroids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each member (ties: the smaller number), and its key."""
    far = distances(x[members], centroids)
    best = far.argmin(axis=1)
    near = np.sqrt(far[np.arange(len(members)), best].astype(np.float64))
    if len(centroids) == 1:
        return best, np.full(len(members), np.inf)
    rest = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(np.float64))
    return best, rest - near - SLACK * (rest + near) + offsets[best]


def _block(ids: pa.Array, x: np.ndarray, heaps: list[Heap], touched: np.ndarray, before: np.ndarray, after: np.ndarray) -> list:
    """A block's row; of the touched vectors the clusters before (-1: none) and after."""
    moved = before != after
    clusters, counts, sums = [], [], []
    for c in np.union1d(before[moved], after[moved]).tolist():
        came, left = touched[moved & (after == c)], touched[moved & (before == c)]
        if c >= 0:
            clusters.append(c)
            counts.append(len(came) - len(left))
            wide = x if int(np.abs(x).max(initial=0)) * len(x) < LONG else x.astype(object)
            sums.append([Decimal(int(v)) for v in wide[came].sum(axis=0) - wide[left].sum(axis=0)])
    flat = [entry for heap in heaps for entry in heap]
    sizes = np.array([len(h) for h in heaps], np.int32)
    keys, members = np.array([k for k, _ in flat], np.float64), np.array([m for _, m in flat], np.int32)
    return [ids, pack(x.ravel()), pack(sizes), pack(keys), pack(members), len(touched), clusters, counts, sums]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, columns[0])]), pa.concat_arrays(columns[0]))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), f.type) for c, f in zip(columns[1:], list(STATE)[1:]))], schema=STATE)


def _first(centroids: list[list[int]], dim: int) -> Callable:
    """Vectors to blocks, each scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.array(centroids, np.int64)
        offsets = np.zeros(len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            every = np.arange(len(x))
            best, keys = _scanned(x, every, centres, offsets)
            heaps = [list(zip(keys[best == c].tolist(), every[best == c].tolist())) for c in range(len(centres))]
            for heap in heaps:
                heapq.heapify(heap)
            yield _batch([_block(batch.column("id"), x, heaps, every, np.full(len(x), -1), best)])

    return run


def _opened(row: dict, dim: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    ends = np.cumsum(unpack(row["sizes"], np.int32))[:-1]
    return unpack(row["vectors"], np.int64).reshape(-1, dim), np.split(unpack(row["keys"], np.float64), ends), np.split(unpack(row["members"], np.int32), ends)


def _next(centroids: list[list[int]], offsets: list[float], dim: int) -> Callable:
    """Blocks to blocks: what the drifts have reached is scanned again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, drift = np.array(centroids, np.int64), np.array(offsets)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("vectors", "sizes", "keys", "members")}
                x, keys, members = _opened(row, dim)
                heaps: list[Heap] = [list(zip(a.tolist(), b.tolist())) for a, b in zip(keys, members)]
                popped, before = [], []
                for c, heap in enumerate(heaps):
                    reach = drift[c] * (1 + SLACK)
                    while heap and heap[0][0] <= reach:
                        popped.append(heapq.heappop(heap)[1])
                        before.append(c)
                touched = np.array(popped, np.int64)
                after = np.empty(0, np.int64)
                if popped:
                    after, again = _scanned(x, touched, centres, drift)
                    for c, key, member in zip(after.tolist(), again.tolist(), popped):
                        heapq.heappush(heaps[c], (key, member))
                yield _batch([_block(batch.column("ids")[k].values, x, heaps, touched, np.array(before, np.int64), after)])

    return run


def _told(centroids: list[list[int]], dim: int) -> Callable:
    """Blocks to rows of id, cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.array(centroids, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                x, _, members = _opened({name: batch.column(name)[k].as_py() for name in ("vectors", "sizes", "keys", "members")}, dim)
                own = np.empty(len(x), np.int32)
                for c, held in enumerate(members):
                    own[held] = c
                far = as_long(own_distances(x, centres[own]))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(own), pa.array(far)], names=["id", "cluster", "distance"])

    return run


def _moves(before: list[list[int]], after: list[list[int]]) -> list[float]:
    """How much each cluster's drift grows: its own move and the largest of the others."""
    move = [float(sum((a - b) ** 2 for a, b in zip(x, y))) ** 0.5 for x, y in zip(before, after)]
    return [m + max([0.0, *move[:c], *move[c + 1 :]]) for c, m in enumerate(move)]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters | None:
    """Clusters of the vectors of ``df`` after so many rounds and a last assignment; None without vectors.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed`` and id.
    """
    spark, vector, id_ = df.sparkSession, named(vector_col), named(id_col).cast("long")
    rows = df.where(sound(vector) & (F.size(vector) == dim)).select(id_.alias("id"), quantised(vector, scale).alias("q"))
    place = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    centroids = [list(r.q) for r in rows.orderBy(place.asc_nulls_last(), "q").limit(k).collect()]
    if not centroids:
        return None
    offsets, counts, sums, scans = [0.0] * len(centroids), [0] * len(centroids), [[0] * dim for _ in centroids], []
    state, path = kept(rows.mapInArrow(_first(centroids, dim), STATE_DDL))
    for _ in range(rounds):
        _added(state, counts, sums, scans)
        moved = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids)]
        offsets = [a + b for a, b in zip(offsets, _moves(centroids, moved))]
        centroids = moved
        last = path
        state, path = kept(state.mapInArrow(_next(centroids, offsets, dim), STATE_DDL))
        discard(spark, last)
    scans.append(state.agg(F.sum("scanned")).first()[0])
    assigned = state.select("ids", "vectors", "sizes", "keys", "members").mapInArrow(_told(centroids, dim), "id long, cluster int, distance long")
    inertias = [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():
        inertias[r.cluster] = int(r.s)
    return Clusters(assigned, centroids, inertias, scans)


def _added(state: DataFrame, counts: list[int], sums: list[list[int]], scans: list[int]) -> None:
    """Adds the blocks' moves to the clusters' counts and sums: one row a cluster and component reaches the driver."""
    moves = state.select(F.explode(F.arrays_zip("clusters", "counts", "sums")).alias("m")).select("m.clusters", "m.counts", F.posexplode("m.sums").alias("at", "s"))
    for r in moves.groupBy("clusters", "at").agg(F.sum("counts").alias("n"), F.sum("s").alias("s")).collect():
        sums[r.clusters][r.at] += int(r.s)
        if r.at == 0:
            counts[r.clusters] += r.n
    scans.append(state.agg(F.sum("scanned")).first()[0])


def digests(clusters: Clusters) -> Column:
    """SHA-256 of a row's final centroid, its components as decimal numbers joined by commas."""
    return F.get(F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in clusters.centroids)), F.col("cluster"))


def inertia(clusters: Clusters) -> tuple[Column, Column]:
    """Of a row's cluster, and of all."""
    own = F.array(*(F.lit(min(x, LONG)).cast("long") for x in clusters.inertias))
    return F.get(own, F.col("cluster")), F.lit(min(sum(clusters.inertias), LONG)).cast("long")
