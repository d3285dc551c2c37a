"""Quality rules at the level of hosts.

Every document is measured (numpy over batches) and tested by some rules; measures and
failures are written without the texts. Spark counts documents and failures of each rule
by host. The failure rates of a rule vary between hosts by more or less than chance; a beta
prior is fitted to that (mean and intraclass correlation by analysis of variance, from
sums over hosts), and each host's rate is shrunk towards the mean:
(failures + a) / (documents + a + b). The rates give the host's verdict on each rule:

* ``trusted``: the rate is below ``trust``; a single failure is taken for a false alarm and
  the document stays,
* ``judged``: documents that fail the rule go,
* ``rejected``: the rate is above ``reject``; all documents of the host go.

Verdicts go back to the documents. Hosts that hold a thousandth of all documents or more
(at most 1000) are few and are broadcast; the others are joined, none of them large.

Base rules hold for each document whatever its host. Null and empty texts have no words;
rows without a host are counted in no host and judged at the prior's mean; repeated rows
count each. Very long texts are measured whole, in memory that grows with the text alone.
With one host, or hosts of one document each, nothing tells how hosts differ: all rates are
the mean. 64-bit hashes stand for words in windows. An empty table gives no rows. Columns
to carry over are named; where one has the name of a result, that gets a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import fresh, named, valid_text, written
from folioscope.llm.words import _BLANK, hashed_words, mix

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Words of a window.
WINDOW = 3
#: Share of all documents from which on a host is broadcast.
LARGE = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on measures; a base rule needs no host."""

    name: str
    fails: str
    base: bool = False


RULES = (
    Rule("short", "n_words < 50", base=True),
    Rule("repeated", "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("lines", "2 * n_dup_lines > n_lines"),
)


def host_of(address: Column) -> Column:
    """The host of an address, lower-cased, without user, port and ``www.``; a plain name stays as it is."""
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(address.contains("://"), F.regexp_replace(F.lower(host), r"^www\.", "")).otherwise(address)


def _measured(data: bytes) -> tuple[int, ...]:
    own = np.frombuffer(data, np.uint8)
    words, _ = hashed_words(own)
    repeats = 0
    if len(words) > WINDOW:
        windows = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            windows = mix(windows) + words[k : k + len(windows)]
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for k in range(WINDOW):
            covered[k : k + len(windows)] |= again
        repeats = int(covered.sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = int((~_BLANK[own] & ((own & 0xC0) != 0x80)).sum())
    return len(words), chars, int(_SYMBOL[own].sum()), len(lines), len(lines) - len(set(lines)), repeats


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([_measured(text.as_py().encode()) for text in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, np.ascontiguousarray(found.T))], names=[*batch.schema.names[1:], *MEASURES])


def measured(df: DataFrame, text_col: str, host: Column, keep: list[str]) -> DataFrame:
    """Columns k0, k1, ... (those to keep), host, the measures, and a column for each rule: whether the document fails it."""
    rows = df.select(valid_text(named(text_col)).alias("text"), *(named(c).alias(f"k{i}") for i, c in enumerate(keep)), host.cast("string").alias("host"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    out = rows.mapInArrow(_measures, ", ".join(kinds + [f"{m} long" for m in MEASURES]))
    return out.select("*", *(F.expr(r.fails).alias(r.name) for r in RULES))


def host_rates(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, documents, a shrunk rate for each rule), and each rule's mean rate.

    From sums over hosts: n documents, f failures. With H hosts, N documents and F
    failures, the mean is F / N and the prior's weight follows from the intraclass
    correlation of the failures; it is between one document and all of them.
    """
    names = [r.name for r in RULES]
    counts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in names))
    counts = written(counts)
    sums = counts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *(F.sum(r).alias(f"f_{r}") for r in names), *(F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"s_{r}") for r in names),
    ).first()
    means = {r: (sums[f"f_{r}"] or 0) / max(1, sums["all"] or 0) for r in names}
    weights = {r: _weight(sums["hosts"], sums["all"] or 0, sums["squares"] or 0.0, sums[f"f_{r}"] or 0, sums[f"s_{r}"] or 0.0) for r in names}
    shrunk = ((F.col(r) + F.lit(means[r] * weights[r])) / (F.col("n") + F.lit(weights[r])) for r in names)
    return counts.select("host", "n", *(x.alias(r) for x, r in zip(shrunk, names))), means


def _weight(hosts: int, total: int, squares: float, failed: int, spread: float) -> float:
    """Documents that the prior weighs as many as; ``spread`` is the sum of f * f / n."""
    if hosts < 2 or total == hosts or failed in (0, total):
        return float(total)
    mean = failed / total
    between = (spread - failed * mean) / (hosts - 1)
    within = (failed - spread) / (total - hosts)
    size = (total - squares / total) / (hosts - 1)
    share = (between - within) / (between + (size - 1) * within)
    return min(max((1 - share) / share, 1.0), float(total)) if share > 0 else float(total)


def judge(df: DataFrame, text_col: str = "text", host: Column | None = None, keep: tuple[str, ...] = ("doc_id",), trust: float = 0.01, reject: float = 0.5) -> DataFrame:
    """The kept columns by their names, then host, the measures, ``base_failed``, ``failed`` (names of the rules that the document fails),
    ``host_rejected`` (the rules of which its host fails too much) and ``kept``."""
    keep = list(keep)
    rows = written(measured(df, text_col, named("source") if host is None else host, keep))
    rates, means = host_rates(rows)
    names = [r.name for r in RULES]
    sayings = lambda rate, r: F.when(rate > reject, "rejected").when(rate < trust, "trusted").otherwise("judged").alias(f"v_{r}")
    verdicts = rates.select("host", "n", *(sayings(F.col(r), r) for r in names))
    least = F.lit(rows.count() / LARGE)
    said = [f"v_{r}" for r in names]
    large = F.broadcast(verdicts.where(F.col("n") >= least).select("host", *said))
    small = verdicts.where(F.col("n") < least).select("host", *said)
    alone = rows.where(F.col("host").isNull()).select("*", *(sayings(F.lit(means[r]), r) for r in names))
    hosted = rows.where(F.col("host").isNotNull())
    joined = hosted.join(large, "host").unionByName(hosted.join(large, "host", "left_anti").join(small, "host")).unionByName(alone)
    list_of = lambda test: F.array_compact(F.array(*(F.when(test(r), r.name) for r in RULES)))
    base = F.exists(F.array(*(F.col(r.name) for r in RULES if r.base)), lambda x: x)
    failed, rejected = list_of(lambda r: F.col(r.name)), list_of(lambda r: F.col(f"v_{r.name}") == "rejected")
    goes = F.exists(F.array(*(F.col(r.name) & (F.col(f"v_{r.name}") != "trusted") for r in RULES)), lambda x: x)
    own = [F.col("host"), *map(F.col, MEASURES), base, failed, rejected, ~base & ~goes & (F.size(rejected) == 0)]
    wanted = fresh(df.select(*map(named, keep)), "host", *MEASURES, "base_failed", "failed", "host_rejected", "kept")
    return joined.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(x.alias(c) for x, c in zip(own, wanted)))
