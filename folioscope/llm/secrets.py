"""Secret scans: patterns, and character Markov models of random strings against identifiers.

The patterns find declared secrets. Two first-order character models then judge every
other run of key characters: one trained on the values that the patterns found (labelled
random strings), one on the other runs of the same texts (labelled ordinary, but for
long ones in which letters and digits change places often: these stay without a label).
A run is read in lower case with its digits and separators as one class each and a mark
where capitals begin inside a word, so that prose teaches what identifiers look like;
names of Python's own library, which every machine has, are labelled ordinary too.

A run is a span of kind ``markov`` if its log-likelihood ratio a character reaches a
threshold. That is the smallest one which at most ``FALSE_RATE`` of the held-out
ordinary runs of the judged length reach, and no more of the held-out names; a fifth of
both, by hash, is held out of the training for it. Models and threshold are counts over all texts, added up by Spark;
their size is fixed by the alphabet.

Null texts count as empty; a base span always stays; runs that touch a base span are
not judged again. Without any labelled secret the random model is uniform. Repeated
rows are scanned each; other columns pass through.
"""

from __future__ import annotations

import importlib
import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import fresh, named, valid_text

# The kinds in their order, and the patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MAY_ASSIGN = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: Runs of so many key characters or more are judged (fewer bear too little evidence); others only teach.
LEAST = 12
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
TAUGHT = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
LETTER = re.compile(r"[A-Za-z]")
CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
#: A long run with so many changes between letters and digits has no label.
CHANGES = 3

#: Classes of the models: edge of a string, a to z, digit, separator, capitals inside a word.
DIGIT, SEPARATOR, CAPITALS, SIZE = 27, 28, 29, 30
#: Share of held-out ordinary runs that may be taken for secrets, and the histogram of ratios it is read from.
FALSE_RATE = 1e-3
LOW, STEP, BINS = -10.0, 0.02, 1000
LEAST_RATIO = 0.3
HELD_OUT = 5
#: Share of the library's names in the ordinary model, and the modules whose names are taken.
NAMES_SHARE = 0.3
MODULES = ("argparse", "ast", "builtins", "collections", "datetime", "email.message", "errno", "http", "inspect", "locale", "logging", "os", "signal", "socket", "ssl", "string", "tokenize", "typing", "unittest", "urllib.request")
#: Weights of the fall-backs of the two models, in characters seen of a class.
RANDOM_PRIOR, ORDINARY_PRIOR = 30.0, 3.0

_CLASS = np.zeros(128, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in "+/_=-"]] = SEPARATOR
_UPPER = np.zeros(128, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(128, bool)
_LOWER[97:123] = True

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end), by start and kind."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if MAY_ASSIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(out)


def _values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random part of each base span."""
    return [ASSIGN.match(text, a)[2] if rank == 0 else text[a:b] for a, rank, b in spans]


def classes(text: str) -> np.ndarray:
    """Classes of the characters between two edges, with a mark before each capital that follows a small letter."""
    data = np.minimum(np.frombuffer(f" {text} ".encode("ascii", "replace"), np.uint8), 127)
    inside = np.flatnonzero(_UPPER[data[1:]] & _LOWER[data[:-1]]) + 1
    return np.insert(_CLASS[data], inside, CAPITALS)


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of the pairs of classes, edges included."""
    cls = classes(" ".join(strings))
    return np.bincount(cls[:-1] * SIZE + cls[1:], minlength=SIZE * SIZE)


def _outside(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks for the spans."""
    cut, last = [], 0
    for a, _, b in spans:
        cut.append(text[last:a])
        last = max(last, b)
    return " ".join([*cut, text[last:]])


def ordinary_runs(text: str) -> list[str]:
    """The runs of a text without base spans that are labelled ordinary."""
    return [r for r in TAUGHT.findall(text) if len(r) < LEAST or len(CHANGE.findall(r)) < CHANGES]


@dataclass
class Model:
    """Log-likelihood ratio of each pair of classes, random against ordinary, and the mean ratio from which a run counts as random."""

    ratios: np.ndarray
    threshold: float

    def score(self, run: str) -> float:
        cls = classes(run)
        return float(self.ratios[cls[:-1], cls[1:]].mean())


def _smoothed(counts: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    return (counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight)


def library_names() -> list[str]:
    """Public names of some modules and of their classes, and paths and dates made of them."""
    names = set(sys.stdlib_module_names)
    for module in map(importlib.import_module, MODULES):
        for name, value in vars(module).items():
            names.update((name, *(vars(value) if isinstance(value, type) else ())))
    out = sorted(n for n in names if not n.startswith("_"))
    # Ordinary runs also join names by separators and with numbers.
    joined = (f"{a}{'/-_='[k % 4]}{b}" for k, (a, b) in enumerate(zip(out, out[7:])))
    dated = (f"{a}-{2000 + k % 30}-{k % 12 + 1:02}-{k % 28 + 1:02}" if k % 2 else f"{a}_{k}" for k, a in enumerate(out[::3]))
    return [*out, *joined, *dated]


def _ratios(random: np.ndarray, ordinary: np.ndarray, names: np.ndarray) -> np.ndarray:
    # Random strings fall back on even odds of all characters, ordinary ones on how often a class occurs at all.
    even = np.array([1.0, *[2.0] * 26, 10.0, 3.0, 10.0])
    often = ordinary.sum(axis=0) + names.sum(axis=0) + 0.5
    texts, own = (_smoothed(x, often / often.sum(), ORDINARY_PRIOR) for x in (ordinary, names))
    return np.log(_smoothed(random, even / even.sum(), RANDOM_PRIOR)) - np.log((1 - NAMES_SHARE) * texts + NAMES_SHARE * own)


def _held_name(name: str) -> bool:
    return zlib.crc32(name.encode()) % HELD_OUT == 0


def _least(scores: np.ndarray, false_rate: float) -> float:
    """The smallest bound on the histogram's grid that at most ``false_rate`` of the counted scores reach."""
    above = scores[::-1].cumsum()[::-1]  # scores in a bin or beyond it
    return LOW + STEP * int(np.argmax(np.append(above, 0) <= false_rate * above[0]))


def _histogram(model: Model, runs: list[str]) -> np.ndarray:
    at = ((np.array([model.score(r) for r in runs]) - LOW) / STEP).astype(np.int64)
    return np.bincount(np.clip(at, 0, BINS - 1), minlength=BINS)


def train(df: DataFrame, text_col: str = "text", false_rate: float = FALSE_RATE) -> Model:
    """Both models from the base spans and the ordinary runs of four fifths of the texts, the threshold from the last fifth."""
    texts = df.select(valid_text(named(text_col)).alias("text")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)

    def count(batches):
        random, ordinary = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                if spans:
                    random += transitions(_values(text, spans))
                    text = _outside(text, spans)
                ordinary += transitions(ordinary_runs(text))
        seen = np.flatnonzero(random + ordinary)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(random[seen]), pa.array(ordinary[seen])], ["pair", "random", "ordinary"])

    counts = texts.where("not held").select("text").mapInArrow(count, "pair long, random long, ordinary long")
    total = np.zeros((2, SIZE * SIZE))
    for pair, random, ordinary in counts.groupBy("pair").agg(F.sum("random"), F.sum("ordinary")).collect():  # SIZE * SIZE rows at most
        total[:, pair] = random, ordinary
    names = library_names()
    model = Model(_ratios(*total.reshape(2, SIZE, SIZE), transitions([n for n in names if not _held_name(n)]).reshape(SIZE, SIZE)), LEAST_RATIO)

    def judged(batches):
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                runs = [r for r in RUN.findall(_outside(text, base_spans(text))) if LETTER.search(r) and len(CHANGE.findall(r)) < CHANGES]
                if runs:
                    seen += _histogram(model, runs)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

    seen = np.zeros(BINS)
    for at, n in texts.where("held").select("text").mapInArrow(judged, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():  # BINS rows at most
        seen[at] = n
    known = _histogram(model, [n for n in names if _held_name(n) and len(n) >= LEAST])
    model.threshold = max(LEAST_RATIO, _least(seen, false_rate), _least(known, false_rate))
    return model


def scan(df: DataFrame, model: Model, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """``df`` with ``spans_col``: array of (start, rank, end, kind), by start and then kind, in code points."""
    spans_col, work = fresh(df, spans_col, "secret_text")
    kind = SPANS.elementType
    arrow = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def found(text: str) -> list[dict]:
        spans = base_spans(text)
        more, k, reached = [], 0, 0
        for m in RUN.finditer(text):
            a, b = m.span()
            # Spans and runs go forward together; of the spans that begin before the run ends, the furthest end counts.
            while k < len(spans) and spans[k][0] < b:
                reached = max(reached, spans[k][2])
                k += 1
            if reached <= a and LETTER.search(m[0]) and model.score(m[0]) >= model.threshold:
                more.append((a, 3, b))
        return [{"start": a, "rank": r, "end": b, "kind": KINDS[r]} for a, r, b in sorted([*spans, *more])]

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(work)
            spans = pa.array([found(t) for t in batch.column(at).to_pylist()], pa.list_(arrow))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), spans], [*(c for c in batch.schema.names if c != work), spans_col])

    schema = T.StructType([*df.schema.fields, T.StructField(spans_col, T.ArrayType(kind))])
    return df.select(*map(named, df.columns), valid_text(named(text_col)).alias(work)).mapInArrow(run, schema)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
