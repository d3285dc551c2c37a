"""Language-model scoring by context-tree weighting, with the trees held as Spark tables.

1. Every task cuts its texts into chunks, packs them and counts each chunk's distinct
   grams (`ctw`) and words, those of held-out texts with a count of 0. They travel as
   sorted, compressed blobs, dealt into buckets: words by their hash, grams by that of
   their nearest ``LEAD`` bytes.
2. A bucket adds up the counts of all chunks: these are its subtrees. They are cut into
   pieces, weighted from the deepest contexts up, and tell the contexts above, which are
   gathered by nearest byte (256 groups, bounded by the alphabet), and those the roots.
3. Down again, roots to nearest bytes to pieces, each gram gets its log probability, and
   every chunk gets those of its grams back, and the counts of its words.
4. A chunk's texts are unpacked, looked up and added up.

No model is broadcast or gathered: the trees grow with the training texts and stay in
tables. Contexts have ``ctw.DEPTH`` bytes at most, as many as a 64-bit gram holds;
none is dropped for being rare. Log probabilities travel with 9 bits of the fraction.

64-bit hashes stand for words. A-Z are lowered. Null texts count as empty: their probability is that of the end alone.
Without training texts every decision is even. Repeated rows are scored each, a null id
is never held out, extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import ctw
from folioscope.llm.blobs import pack, squeezed, unpack, whole
from folioscope.llm.common import named, valid_text, written
from folioscope.llm.words import hashed_words

#: Text bytes of a chunk (of a task's texts) and of a slice whose grams are taken at once.
CHUNK_BYTES, SLICE_BYTES = 48 << 20, 1 << 20
#: Counted keys that a task holds before it adds them up.
HELD_KEYS = 4_000_000
#: Nearest bytes that decide a gram's bucket; text bytes for each bucket and the most buckets.
LEAD, BUCKET_BYTES, MOST_BUCKETS = 3, 16 << 20, 4096
#: Keys of a piece of a bucket, about.
PIECE_KEYS = 1 << 18
#: What a blob holds.
GRAMS, WORDS = 0, 1

COUNTED_DDL = (
    "chunk long, what int, bucket int, keys binary, counts binary, "
    "ids array<long>, missing array<boolean>, held array<boolean>, sizes array<int>, texts binary, trained long"
)
COUNTED = pa.schema([
    ("chunk", pa.int64()), ("what", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("missing", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())),
    ("sizes", pa.list_(pa.int32())), ("texts", pa.binary()), ("trained", pa.int64()),
])
BUILT = "kind int, bucket int, piece int, nearest int, keys binary, counts binary, weights binary, total long, known long"
SCORED = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long"


def is_held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 7 == 2


def _rounded(logs: np.ndarray) -> np.ndarray:
    """As 32-bit floats whose fraction has 9 bits, which pack well."""
    bits = logs.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(1 << 13)) & np.uint32(0xFFFFC000)).view(np.float32)


def _bucket(keys: np.ndarray, what: int, buckets: int) -> np.ndarray:
    of = keys >> np.uint64(8 * (ctw.DEPTH + 1 - LEAD)) if what == GRAMS else keys
    mixed = (of + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the text that it is in."""
    hashes, starts = hashed_words(np.frombuffer(b" ".join(texts), np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, starts, "right")


class _Counts:
    """Counts of keys, added up whenever many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.floor = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.floor + HELD_KEYS:
            self.parts = [ctw.merged(self.parts)]
            self.size = self.floor = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        return ctw.merged([none, *self.parts])


def _rows(schema: str, **columns: list) -> pd.DataFrame:
    """A batch of the named columns; the others are null."""
    names = [c.split()[0] for c in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pd.DataFrame({c: pd.Series(columns.get(c, [None] * n), dtype=object) for c in names})


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text; a longer text is one alone."""
    for batch in batches:
        place = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // most
        ends = [*np.flatnonzero(np.diff(place, prepend=-1)), len(place)]
        for a, b in zip(ends, ends[1:]):
            yield batch.slice(a, b - a)


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the named columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _count(docs: DataFrame, buckets: int) -> DataFrame:
    """The packed texts of every chunk, and its grams and words by bucket."""

    def told(chunk: int, what: int, counts: _Counts) -> Iterator[pa.RecordBatch]:
        keys, n = counts.all()
        bucket = _bucket(keys, what, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, n, ends = keys[order], n[order].astype(np.uint32), np.searchsorted(bucket[order], np.arange(buckets + 1))
        for first in range(0, buckets, 64):
            at = [b for b in range(first, min(first + 64, buckets)) if ends[b] < ends[b + 1]]
            spans = [slice(ends[b], ends[b + 1]) for b in at]
            if at:
                yield _batch(COUNTED, chunk=[chunk] * len(at), what=[what] * len(at), bucket=at, keys=[pack(keys[x]) for x in spans], counts=[pack(n[x]) for x in spans])

    def run(batches):
        counts, size, chunk = {GRAMS: _Counts(), WORDS: _Counts()}, 0, 0
        for part in _slices(batches, SLICE_BYTES):
            if not size:
                # The table is written once, so that a chunk's number need not be the same in another attempt.
                chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            texts = [t.encode().lower() for t in part["text"].to_pylist()]
            held = part["held"].to_pylist()
            for out in (False, True):
                own = [t for t, h in zip(texts, held) if h == out]
                for what, keys in ((GRAMS, ctw.grams(own)), (WORDS, _words(own)[0])) if own else ():
                    keys, n = np.unique(keys, return_counts=True)
                    counts[what].add(keys, np.zeros(len(n), np.uint32) if out else n.astype(np.uint32))
            names = {"ids": "id", "missing": "missing", "held": "held"}
            packed = {c: pa.ListArray.from_arrays([0, len(texts)], part[own]) for c, own in names.items()}
            yield _batch(COUNTED, chunk=[chunk], **packed, sizes=[[len(t) for t in texts]], texts=[squeezed(b"".join(texts))], trained=[held.count(False)])
            size += sum(map(len, texts)) + len(texts)
            if size >= CHUNK_BYTES:
                for what, own in counts.items():
                    yield from told(chunk, what, own)
                counts, size = {GRAMS: _Counts(), WORDS: _Counts()}, 0
        for what, own in counts.items() if size else ():
            yield from told(chunk, what, own)

    return docs.mapInArrow(run, COUNTED_DDL)


def _build(counted: DataFrame) -> DataFrame:
    """Of every bucket, its pieces of grams (kind 0), what they tell each nearest byte (kind 1), and its words (kind 2)."""

    def pieces(bucket: int, counts: _Counts) -> Iterator[pd.DataFrame]:
        keys, n = counts.all()
        lead = keys >> np.uint64(8 * (ctw.DEPTH + 1 - LEAD))
        starts = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        place = starts // PIECE_KEYS
        cuts = [*starts[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))], len(keys)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield _rows(BUILT, kind=[0], bucket=[bucket], piece=[piece], keys=[pack(keys[a:b])], counts=[pack(n[a:b])])
            top, total, weights = ctw.Segment(keys[a:b], n[a:b], ctw.DEPTH - LEAD).top()
            nearest = (top >> np.uint64(8 * LEAD)).astype(np.int64)
            ends = np.flatnonzero(np.diff(nearest, prepend=-1, append=-1))
            spans = list(zip(ends, ends[1:]))
            yield _rows(
                BUILT,
                kind=[1] * len(spans),
                bucket=[bucket] * len(spans),
                piece=[piece] * len(spans),
                nearest=[int(nearest[c]) for c, _ in spans],
                keys=[pack(top[c:d]) for c, d in spans],
                counts=[pack(total[c:d]) for c, d in spans],
                weights=[pack(weights[:, c:d].reshape(-1)) for c, d in spans],
            )

    def told(bucket: int, what: int, counts: _Counts) -> Iterator[pd.DataFrame]:
        if what == GRAMS:
            yield from pieces(bucket, counts)
        else:
            keys, n = counts.all()
            yield _rows(BUILT, kind=[2], bucket=[bucket], keys=[pack(keys)], counts=[pack(n)], total=[int(n.sum())], known=[int((n > 0).sum())])

    def run(batches):
        own, counts = None, _Counts()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.bucket, r.what) != own:
                    if own is not None:
                        yield from told(*own, counts)
                    own, counts = (r.bucket, r.what), _Counts()
                counts.add(unpack(r.keys, np.uint64), unpack(r.counts, np.uint32).astype(np.int64))
        if own is not None:
            yield from told(*own, counts)

    blobs = counted.where("bucket is not null").select("bucket", "what", "keys", "counts")
    return blobs.repartition("bucket", "what").sortWithinPartitions("bucket", "what").mapInPandas(run, BUILT)


def _tops(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and weights told by several pieces, sorted, and the row that each key is from."""
    keys = [unpack(k, np.uint64) for k in pdf["keys"]]
    source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    counts = np.concatenate([unpack(n, np.int64) for n in pdf["counts"]])
    weights = np.concatenate([unpack(w, np.float64).reshape(8, -1) for w in pdf["weights"]], axis=1)
    return keys[order], counts[order], weights[:, order], source[order]


def _arrivals(built: DataFrame) -> DataFrame:
    """(bucket, piece, nearest, above): what reaches the shallowest contexts of each piece."""
    told = built.where("kind = 1").select("bucket", "piece", "nearest", "keys", "counts", "weights")

    def up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts, weights, _ = _tops(pdf)
        keys, counts, weights = ctw.Segment(keys, counts, LEAD - 1, weights).top()
        return pd.DataFrame({"nearest": [key[0]], "keys": [pack(keys)], "counts": [pack(counts)], "weights": [pack(weights.reshape(-1))]})

    # One row of at most 256 keys for each of at most 256 bytes.
    rows = told.groupBy("nearest").applyInPandas(up, "nearest int, keys binary, counts binary, weights binary").toPandas()
    reach: dict[int, np.ndarray] = {}
    if len(rows):
        keys, counts, weights, source = _tops(rows)
        arrived = ctw.Segment(keys, counts, 1, weights).arrive()
        reach = {int(byte): arrived[:, :, source == k] for k, byte in enumerate(rows["nearest"])}
    shared = built.sparkSession.sparkContext.broadcast(reach)

    def down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts, weights, source = _tops(pdf)
        arrived = ctw.Segment(keys, counts, LEAD - 1, weights).arrive(shared.value[int(key[0])])
        above = [pack(arrived[:, :, source == k].reshape(-1)) for k in range(len(pdf))]
        return pd.DataFrame({"bucket": pdf["bucket"], "piece": pdf["piece"], "nearest": int(key[0]), "above": above})

    return told.groupBy("nearest").applyInPandas(down, "bucket int, piece int, nearest int, above binary")


def _answers(counted: DataFrame, built: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(chunk, what, keys, values): the log probabilities of each chunk's grams and the counts of its words, by bucket."""
    # No nulls in numbers: pandas would make them floats.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
    rows = arrivals.select("bucket", F.lit(GRAMS).alias("what"), F.lit(0).alias("step"), "piece", "nearest", zero.alias("chunk"), F.col("above").alias("blob"), none.alias("counts"))
    own = built.where("kind = 0").select("bucket", F.lit(GRAMS), F.lit(1), "piece", F.lit(0), zero, "keys", "counts")
    words = built.where("kind = 2").select("bucket", F.lit(WORDS), F.lit(1), F.lit(0), F.lit(0), zero, "keys", "counts")
    asks = counted.where("bucket is not null").select("bucket", "what", F.lit(2), F.lit(0), F.lit(0), "chunk", "keys", none)
    met = rows.union(own).union(words).union(asks).repartition("bucket", "what").sortWithinPartitions("bucket", "what", "step", "piece", "nearest")

    def run(batches):
        bucket, above, keys, values = None, {}, [], []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.bucket, r.what) != bucket:
                    bucket, above, keys, values = (r.bucket, r.what), {}, [], []
                if r.step == 0:
                    above.setdefault(r.piece, []).append(unpack(r.blob, np.float64).reshape(8, 3, -1))
                elif r.step == 1:
                    keys.append(unpack(r.blob, np.uint64))
                    counts = unpack(r.counts, np.int64)
                    # Arrivals stand by nearest byte, in the order of the segment's highest level.
                    grams = r.what == GRAMS
                    values.append(_rounded(ctw.Segment(keys[-1], counts, ctw.DEPTH - LEAD).logs(np.concatenate(above.pop(r.piece), axis=2))) if grams else counts)
                else:
                    if len(keys) > 1:
                        keys, values = [np.concatenate(keys)], [np.concatenate(values)]
                    own = values[0][np.searchsorted(keys[0], unpack(r.blob, np.uint64))]
                    yield pd.DataFrame({"chunk": [r.chunk], "what": [r.what], "keys": [r.blob], "values": [pack(own)]})

    return met.mapInPandas(run, "chunk long, what int, keys binary, values binary")


class _Looked:
    """The values of a chunk's keys of one kind, sent bucket by bucket."""

    def __init__(self, kind: type):
        self.kind, self.blobs, self.table = kind, [], None

    def add(self, keys: bytes, values: bytes) -> None:
        self.blobs.append((keys, values))

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.table is None:
            sizes = [int.from_bytes(k[:8], "little") for k, _ in self.blobs]
            ends = np.cumsum([0, *sizes])
            self.values = np.concatenate([np.empty(0, self.kind), *(unpack(v, self.kind) for _, v in self.blobs)])
            blobs = [k for k, _ in self.blobs]
            places = lambda: ((unpack(k, np.uint64), np.arange(a, b, dtype=np.uint64)) for k, a, b in zip(blobs, ends, ends[1:]))
            self.table, self.blobs = ctw.Table(int(ends[-1]), places), []
        return self.values[self.table.get(keys)]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[Column], Column] = is_held_out) -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score (word unigrams), score (the model's log10 probability) and bits_per_byte.

    ``held_out`` tells from the column of ids which texts are kept from the training.
    """
    # No nulls in numbers: pandas would make them floats.
    id_ = named(id_col).cast("long")
    docs = df.select(
        F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("missing"), valid_text(named(text_col)).alias("text"), F.coalesce(held_out(id_), F.lit(False)).alias("held")
    )
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    counted = written(_count(docs, min(MOST_BUCKETS, max(16, -(-size // BUCKET_BYTES)))))
    built = written(_build(counted))
    answers = _answers(counted, built, _arrivals(built))

    of = lambda column: F.coalesce(F.sum(column), F.lit(0))
    ends, chunks = counted.agg(of("trained"), F.count_distinct("chunk")).first()
    total, distinct = built.where("kind = 2").agg(of("total"), of("known")).first()
    total += ends
    least = -math.log10(total + distinct + (ends > 0) + 1)
    end = math.log10(ends + 1) + least

    packs = counted.where("texts is not null").select("chunk", F.lit(2).alias("what"), "ids", "missing", "held", "sizes", "texts")
    met = answers.unionByName(packs, allowMissingColumns=True).repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "what")

    def run(batches):
        chunk, looked = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch[c][k] for c in batch.schema.names}
                if r["chunk"].as_py() != chunk:
                    chunk, looked = r["chunk"].as_py(), {GRAMS: _Looked(np.float32), WORDS: _Looked(np.int64)}
                what = r["what"].as_py()
                if what < 2:
                    looked[what].add(r["keys"].as_py(), r["values"].as_py())
                    continue
                edges = np.cumsum([0, *r["sizes"].values.to_numpy()])
                data = whole(r["texts"].as_buffer(), int(edges[-1]))
                texts = [data[a:b] for a, b in zip(edges, edges[1:])]
                logs = looked[GRAMS].of(ctw.grams(texts)).astype(np.float64)
                hashes, owner = _words(texts)
                seen = looked[WORDS].of(hashes)
                n, ids, missing = len(texts), r["ids"].values, r["missing"].values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids.to_numpy(), mask=missing),
                    "held_out": r["held"].values,
                    "n_tokens": np.bincount(owner, minlength=n) + 1,
                    "n_known": np.bincount(owner[seen > 0], minlength=n) + (ends > 0),
                    "base": np.bincount(owner, np.log10(seen + 1.0) + least, n) + end,
                    "score": np.add.reduceat(logs, edges[:-1] + np.arange(n)),
                    "bytes": np.diff(edges),
                })

    rows = met.mapInArrow(run, SCORED)
    return rows.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
