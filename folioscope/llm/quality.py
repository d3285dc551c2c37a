"""Quality classifier by co-training of two views.

The text view sees which of some telling words (by hash) occur and the shape of the
text, the metadata view sees language, source and length. Each is a logistic regression;
the words are those whose presence and the label depend on each other most (chi-square)
in the rows that are fitted, for each target its own. In every round each view
scores all documents that it was not fitted on; those of which it is confident join the
training rows of the other view. They join as means: all documents of a pseudo-label
that share a cell (a hash of language and source) are one row, which Spark adds up, so
that every confident document counts and what fitting reads has a fixed size. The views
are then calibrated on labelled rows held out from the fitting (Platt scaling), and
every document gets the two calibrated log odds added up, less one prior.

Labels have two columns: ``quality`` and ``toxic``. A document is accepted if it is
likely of good quality and likely not toxic; each of the two has its own pair of views.

Fitting takes at most ``fit_rows`` labelled rows, chosen by hash of id; the exchange of
pseudo-labels and the scoring cover all rows. With few labels, or labels of one class
only, the score is the share of good labels (0.5 without any) for all. Null texts count
as empty, null metadata is a value of its own, label rows with a null are not used,
several labels of one document are averaged; of several rows of one labelled document
the least text is fitted. Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import beside_text, fresh, named, release, slices, texts_of, valid_text
from folioscope.llm.words import hashed_words

#: Labelled rows that fitting reads.
FIT_ROWS = 3000
ROUNDS = 3
#: A view is confident of what it holds nine times likelier than not.
CONFIDENT = 0.9
#: Rows into which the pseudo-labelled documents of a class are added up.
CELLS = 8
#: Hashed features of the two views, and of the words those that a model takes, found in so many fitted rows.
WORDS, META = 1 << 18, 64
SHAPES = 11
VIEWS = ("text", "meta")
TAKEN, LEAST_ROWS = 256, 5
TARGETS = ("quality", "toxic")
#: Bytes of text whose features are taken at once.
SLICE_BYTES = 1 << 20

# Classes of bytes: word characters (all bytes beyond ASCII are), capitals, and marks that prose rarely has.
_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(65, 91), *range(48, 58), *range(128, 256)]] = True
_LETTER = _WORD.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*|<>{}=~^")] = True


@dataclass
class Rows:
    """Sparse rows of one view: the row of each entry, its feature and its value."""

    size: int
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def among(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the sorted ``ids``, and value of the entries whose feature is among them."""
        at = np.minimum(np.searchsorted(ids, self.feature), len(ids) - 1)
        held = ids[at] == self.feature
        return self.row[held], at[held], self.value[held]

    def margins(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        row, at, value = self.among(ids)
        return np.bincount(row, w[at] * value, self.size) + w[-1]

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """As a matrix with a last column of ones."""
        out = np.zeros((self.size, len(ids) + 1), np.float32)
        row, at, value = self.among(ids)
        out[row, at] = value
        out[:, -1] = 1
        return out


def text_rows(texts: list[str]) -> Rows:
    """Which hashed words occur, then the shape of each text."""
    raw = [t.encode() for t in texts]
    n = len(raw)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in raw[:-1])])
    chars = np.maximum([len(t) for t in raw], 1)
    lower = np.where(_UPPER[data], data + np.uint8(32), data)
    hashes, starts = hashed_words(np.where(_WORD[data], lower, np.uint8(32)))
    owner = np.searchsorted(first, starts, "right") - 1
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    pairs, times = np.unique(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    row = pairs // WORDS
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    share = lambda table: np.add.reduceat(table[data].astype(np.int64), first) / chars
    letters = share(_LETTER)
    shape = np.stack([
        letters, np.bincount(row, minlength=n) / some, np.minimum(letters * chars / some, 30) / 10, share(_UPPER) / np.maximum(letters, 1e-9),
        np.bincount(owner[again], minlength=n) / some, np.minimum(1.0, 8 * share(_MARK)), np.minimum(1.0, 10 * share(np.arange(256) == 124)),
        20 * share(np.arange(256) == 10), np.minimum(np.log1p(words), 12) / 6, words < 5, most / some,
    ], axis=1)
    return Rows(
        n,
        np.concatenate([row, np.repeat(np.arange(n), SHAPES)]),
        np.concatenate([pairs % WORDS, np.tile(WORDS + np.arange(SHAPES), n)]),
        np.concatenate([np.ones(len(row)), shape.reshape(-1)]),
    )


def meta_rows(langs: list[str | None], sources: list[str | None], texts: list[str]) -> Rows:
    half = META // 2 - 1
    lang = [zlib.crc32(f"lang {x}".encode()) % half for x in langs]
    source = [half + zlib.crc32(f"source {x}".encode()) % half for x in sources]
    size = np.minimum(np.log1p([len(t) for t in texts]), 14) / 7
    n = len(texts)
    feature = np.stack([lang, source, np.full(n, META - 2)], axis=1) if n else np.empty((0, 3), np.int64)
    value = np.stack([np.ones(n), np.ones(n), size], axis=1)
    return Rows(n, np.repeat(np.arange(n), 3), feature.reshape(-1).astype(np.int64), value.reshape(-1))


def fit(x: np.ndarray, y: np.ndarray, count: np.ndarray, l2: float, steps: int = 100) -> np.ndarray:
    """Weights of a logistic regression by accelerated gradient descent; rows count ``count`` times, classes are balanced, the last column of ``x`` is 1."""
    good = float((count * y).sum() / count.sum())
    weight = count * np.where(y > 0.5, 0.5 / max(good, 1e-9), 0.5 / max(1 - good, 1e-9)) / count.sum()
    # One precision throughout: a product of two would copy the whole matrix.
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 0
    w = v = np.zeros(x.shape[1], np.float32)
    # An upper bound of the curvature: a quarter of the largest eigenvalue of X'WX.
    u = np.full(x.shape[1], x.shape[1] ** -0.5, np.float32)
    for _ in range(15):
        u = x.T @ (weight * (x @ u))
        size = np.linalg.norm(u)
        u = (u / max(size, 1e-12)).astype(np.float32)
    step = np.float32(1 / (0.3 * size + l2))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        new = v - step * (x.T @ (weight * (p - y)) + penalty * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset of the log odds, by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        r = p * (1 - p) + 1e-9
        g = np.array([((p - y) * m).sum() + (a - 1), (p - y).sum() + 0.01 * b])
        h = np.array([[(r * m * m).sum() + 1, (r * m).sum()], [(r * m).sum(), r.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        scale = min(1.0, 4 / max(np.abs(d).max(), 1e-12))
        a, b = a - scale * d[0], b - scale * d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Views:
    """Calibrated linear models of one target; no weights where it has too few labels or one class."""

    prior: float
    ids: dict[str, np.ndarray] | None = None
    weights: dict[str, np.ndarray] | None = None
    scales: dict[str, tuple[float, float]] | None = None

    def odds(self, rows: dict[str, Rows]) -> dict[str, np.ndarray]:
        """Calibrated log odds of each view."""
        return {v: self.scales[v][0] * r.margins(self.ids[v], self.weights[v]) + self.scales[v][1] for v, r in rows.items()}

    def log_odds(self, rows: dict[str, Rows]) -> np.ndarray:
        prior = np.log(self.prior / (1 - self.prior))
        if self.weights is None:
            return np.full(rows["text"].size, prior)
        return sum(self.odds(rows).values()) - prior


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _telling(rows: Rows, y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The words of the fitted rows that the label depends on most."""
    own = train[rows.row] & (rows.feature < WORDS)
    share = y[train].mean()
    held = np.bincount(rows.feature[own], minlength=WORDS)
    good = np.bincount(rows.feature[own], y[rows.row[own]], WORDS)
    chi = np.where(held >= LEAST_ROWS, (good - held * share) ** 2 / np.maximum(held, 1), -1.0)
    return np.sort(np.argsort(-chi, kind="stable")[: min(TAKEN, int((chi >= 0).sum()))])


class _Target:
    """The labelled rows of one target, in three parts: fitted, asked for the confidence of pseudo-labels, and kept for the last calibration."""

    def __init__(self, rows: dict[str, Rows], y: np.ndarray):
        self.y = y
        share = float(y.mean()) if len(y) else 0.5
        self.prior = min(max(share, 1e-3), 1 - 1e-3)
        part = np.arange(len(y)) % 6
        parts = [part < 4, part == 4, part == 5]
        if any(len(set(y[p])) < 2 for p in parts):
            parts = [np.ones(len(y), bool)] * 3
        self.train, self.asked, self.kept = parts
        self.able = len(y) >= 10 and 0 < share < 1
        self.weights: dict[str, np.ndarray] = {}
        if self.able:
            self.ids = {"text": np.concatenate([_telling(rows["text"], y, self.train), WORDS + np.arange(SHAPES)]), "meta": np.arange(META)}
            self.x = {v: rows[v].dense(self.ids[v]) for v in VIEWS}

    def fit(self, given: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Both views, with the means that each is given of the other's confident documents: rows, labels and counts."""
        for view, l2 in (("text", 1e-2), ("meta", 1e-3)):
            x, y, count = self.x[view][self.train], self.y[self.train], np.ones(int(self.train.sum()))
            means, labels, many = given.get(view, (x[:0], y[:0], count[:0]))
            # Pseudo-labels weigh as much as the labelled rows at most.
            many = many * min(1.0, len(y) / max(many.sum(), 1))
            self.weights[view] = fit(np.vstack([x, means]), np.concatenate([y, labels]), np.concatenate([count, many]), l2)

    def views(self, rows: np.ndarray) -> Views:
        """The views, calibrated on ``rows``."""
        if not self.able:
            return Views(self.prior)
        scales = {v: calibrate(self.x[v][rows] @ w.astype(np.float32), self.y[rows]) for v, w in self.weights.items()}
        return Views(self.prior, self.ids, dict(self.weights), scales)


def _featured(batch: pa.RecordBatch, whole: pa.Array, lang: str, source: str) -> Iterator[tuple[pa.RecordBatch, dict[str, Rows], list[tuple]]]:
    """Slices of a batch, whose texts are ``whole``, with the rows of both views and their metadata."""
    for a, b in slices(whole, SLICE_BYTES):
        part = batch.slice(a, b - a)
        texts, langs, sources = whole.slice(a, b - a).to_pylist(), part[lang].to_pylist(), part[source].to_pylist()
        yield part, {"text": text_rows(texts), "meta": meta_rows(langs, sources, texts)}, list(zip(langs, sources))


def _pseudo_labelled(docs: DataFrame, models: dict[str, Views], fitted: list[int]) -> dict[str, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each target and view, the means of the documents that the other view is confident of, by class and cell."""
    slots = {(t, v): k for k, (t, v) in enumerate((t, v) for t in models for v in VIEWS)}
    own_ids = set(fitted)

    def run(batches):
        sums = {(t, v): np.zeros((2 * CELLS, len(models[t].ids[v]) + 1)) for t, v in slots}
        for batch in batches:
            for part, rows, metas in _featured(batch, batch["text"], "lang", "source"):
                cell = np.array([zlib.crc32(repr(m).encode()) % CELLS for m in metas])
                free = np.array([i not in own_ids for i in part["id"].to_pylist()])
                for target, model in models.items():
                    for view, odds in model.odds(rows).items():
                        other = "meta" if view == "text" else "text"
                        p = _probability(odds)
                        chosen = free & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                        slot = np.where(chosen, (p > 0.5) * CELLS + cell, -1)
                        total = sums[target, other]
                        row, at, value = rows[other].among(model.ids[other])
                        use = slot[row] >= 0
                        total += np.bincount(slot[row[use]] * total.shape[1] + at[use], value[use], total.size).reshape(total.shape)
                        total[:, -1] += np.bincount(slot[chosen], minlength=2 * CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(list(slots.values()), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()])], ["slot", "sums"])
        batch = part = rows = None
        release()

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for slot, blob in zip(pdf["slot"], pdf["sums"]):
                totals[slot] = totals.get(slot, 0) + np.frombuffer(blob, np.float32).astype(np.float64)
        yield pd.DataFrame({"slot": pd.Series(list(totals), dtype="int32"), "sums": [x.tobytes() for x in totals.values()]})

    told = docs.mapInArrow(run, "slot int, sums binary").repartition("slot").mapInPandas(add, "slot int, sums binary")
    by_slot = {r.slot: r.sums for r in told.collect()}  # one row a target and view
    out: dict[str, dict] = {t: {} for t in models}
    for (target, view), slot in slots.items():
        width = len(models[target].ids[view]) + 1
        sums = np.frombuffer(by_slot[slot]).reshape(2 * CELLS, width) if slot in by_slot else np.zeros((2 * CELLS, width))
        some = sums[:, -1] > 0
        many = sums[some, -1]
        # The last column becomes 1: the mean of ones.
        out[target][view] = (sums[some] / many[:, None]).astype(np.float32), (np.flatnonzero(some) >= CELLS).astype(float), many
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fit_rows: int = FIT_ROWS) -> dict[str, Views]:
    """The models of both targets, fitted on a bounded sample of labels and on pseudo-labels of all documents."""
    good = named(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    marked = labels.where(good).groupBy(named(id_col).cast("long").alias("id")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    ids = marked.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    plain = docs.select(
        named(id_col).cast("long").alias("id"), valid_text(named(text_col)).alias("text"), named(lang_col).cast("string").alias("lang"), named(source_col).cast("string").alias("source")
    )
    # fit_rows ids at most.
    own = plain.join(F.broadcast(ids), "id").groupBy("id", "quality", "toxic").agg(F.min(F.struct("text", "lang", "source")).alias("x"))

    def features(batches):
        for pdf in batches:
            rows = {"text": text_rows(list(pdf["text"])), "meta": meta_rows(list(pdf["lang"]), list(pdf["source"]), list(pdf["text"]))}
            columns = {}
            for view, r in rows.items():
                order = np.argsort(r.row, kind="stable")
                ends = np.searchsorted(r.row[order], np.arange(1, r.size))
                for name, values in (("at", r.feature[order].astype(np.int32)), ("value", r.value[order])):
                    columns[f"{view}_{name}"] = [x.tobytes() for x in np.split(values, ends)]
            yield pd.DataFrame({"id": pdf["id"], "quality": pdf["quality"], "toxic": pdf["toxic"], **columns})

    # As bytes: lists would be an object of Python for each number on the driver.
    schema = "id long, quality double, toxic double, text_at binary, text_value binary, meta_at binary, meta_value binary"
    held = own.select("id", "quality", "toxic", "x.*").mapInPandas(features, schema).toPandas()
    held = held.assign(order=[zlib.crc32(str(i).encode()) for i in held["id"]]).sort_values(["order", "id"])
    rows = {view: _joined(held.pop(f"{view}_at"), held.pop(f"{view}_value")) for view in VIEWS}
    targets = {t: _Target(rows, (held[t].to_numpy() >= 0.5).astype(float)) for t in TARGETS}
    able = {t: target for t, target in targets.items() if target.able}
    given: dict[str, dict] = {t: {} for t in able}
    for turn in range(ROUNDS + 1 if able else 0):
        for t, target in able.items():
            target.fit(given[t])
        if turn < ROUNDS:
            given = _pseudo_labelled(plain, {t: target.views(target.asked) for t, target in able.items()}, held["id"].tolist())
    return {t: target.views(target.kept) for t, target in targets.items()}


def _joined(places: pd.Series, values: pd.Series) -> Rows:
    whole = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
    sizes = [len(x) // 4 for x in places]
    return Rows(len(places), np.repeat(np.arange(len(places)), sizes), whole(places, np.int32).astype(np.int64), whole(values, np.float64))


def score(docs: DataFrame, models: dict[str, Views], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with quality_score and toxic_score (probabilities) and accepted."""
    q_col, t_col, ok_col, w_text, w_lang, w_source = fresh(docs, "quality_score", "toxic_score", "accepted", "qc_text", "qc_lang", "qc_source")
    beside, own = beside_text(docs, text_col)

    def run(batches):
        for batch in batches:
            for part, rows, _ in _featured(batch, texts_of(batch, w_text, own), w_lang, w_source):
                q, toxic = (_probability(models[t].log_odds(rows)) for t in TARGETS)
                kept = [(c, n) for c, n in zip(part.columns, part.schema.names) if n not in (w_text, w_lang, w_source)]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(q), pa.array(toxic), pa.array((q >= 0.5) & (toxic < 0.5))], [*(n for _, n in kept), q_col, t_col, ok_col])
        batch = part = rows = kept = None
        release()

    work = docs.select(*map(named, docs.columns), beside.alias(w_text), named(lang_col).cast("string").alias(w_lang), named(source_col).cast("string").alias(w_source))
    schema = T.StructType([*docs.schema.fields, T.StructField(q_col, T.DoubleType()), T.StructField(t_col, T.DoubleType()), T.StructField(ok_col, T.BooleanType())])
    return work.mapInArrow(run, schema)
