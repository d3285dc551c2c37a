"""Centroid clustering, host rules and hard negatives: against plain computations, on odd input, and for what their methods save."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import clustering, hostrules, negatives, queries

SF = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, scale):
    """Cluster and distance of each vector, and the centroids, by full scans."""
    xs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(xs, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in xs]
        if step < rounds:
            for c in range(len(centres)):
                held = [v for (_, v), o in zip(xs, own) if o == c]
                if held:
                    centres[c] = [sum(col) // len(held) for col in zip(*held)]
    return sorted(((i if i is not None else -1), o, far(v, centres[o])) for (i, v), o in zip(xs, own)), centres


@pytest.mark.parametrize("kind", ["spread", "copies", "few", "huge"])
def test_clusters_equal_full_scans(spark, kind):
    rng = random.Random(kind)
    if kind == "spread":
        rows = [(k, [rng.gauss(3 * (k % 5), 1) for _ in range(4)]) for k in range(600)]
    elif kind == "copies":
        rows = [(k, [1.0, 2.0, 0.5, 0.0] if k % 3 else [float(rng.randrange(3)) for _ in range(4)]) for k in range(300)] + [(7, [0.0] * 4)] * 3 + [(None, [1.0] * 4)]
    elif kind == "few":
        rows = [(1, [0.0, 1.0, 2.0, 3.0]), (2, [0.0, 1.0, 2.0, 3.0]), (3, [-1.0, 0.0, 0.0, 0.0])]
    else:
        rows = [(k, [rng.choice([-1.0, 1.0]) * 10 ** rng.randrange(6, 8) + k for _ in range(4)]) for k in range(60)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0]), (903, [1.0]), (904, []), (905, [float("inf")] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    found = clustering.cluster(df, k=8, rounds=4, dim=4, scale=64)
    want, centres = lloyd(rows, 8, 4, 64)
    got = sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in found.assigned.collect())
    assert got == want and found.centroids == centres
    assert found.inertias == [sum(d for _, c, d in want if c == k) for k in range(len(centres))]


def test_heaps_leave_most_vectors_unseen(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(20 * (k % 4), 1), rng.gauss(0, 1)]) for k in range(2000)]
    found = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, rounds=6, dim=2)
    assert found.scans[0] == 2000 and found.scans[-1] < 200


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster(df) is None
    assert negatives.mine(df.withColumn("label", F.lit(1)), F.lit(True)).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(3)
    texts = ["", None, " \n\t ", "a a a", "a b a b a b", "a\r\nb\n\n a\r\n", "x\x0by\x0cz", "é 𝐀 # 中|文   \x1c", "one " * 30_000] + ["".join(rng.choices(["a", "b", " ", "\n", "#", "é", "\t"], k=rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(None).cast("string"))
    out = hostrules.judge(df, host=F.lit("h"), keep=("doc_id", "n_words", "kept"))
    assert out.columns[:4] == ["doc_id", "n_words", "kept", "host"] and "_n_words" in out.columns and "_kept" in out.columns
    for r in out.collect():
        assert (r._n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id] or "")


def good(k):
    return " ".join(f"word{k}x{j}" for j in range(60))


def test_hosts_judge_documents(spark):
    """A host of failures goes as a whole; a single failure of a host without others stays; elsewhere it goes; a small host is drawn to the mean."""
    bad = lambda k: good(k) + " #" * 40
    rows = [("clean", good(k)) for k in range(400)] + [("clean", bad(1))] + [("farm", bad(k) if k % 10 else good(k)) for k in range(200)] + [("mixed", bad(k) if k % 12 == 0 else good(k)) for k in range(240)]
    rows += [("one", bad(5))] + [(f"host{k}", good(k)) for k in range(60)] + [(None, bad(7)), (None, good(8)), ("clean", "too short")]
    df = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in hostrules.judge(df).collect()}
    assert len(got) == len(rows)
    for k, (h, t) in enumerate(rows):
        fails = t.endswith("#")
        assert got[k].kept == {"clean": t != "too short", "farm": False, "mixed": not fails, "one": False, None: not fails}.get(h, True)
        assert got[k].base_failed == (t == "too short") and got[k].failed == (["short"] if t == "too short" else ["symbols"] if fails else [])
    assert got[450].host_rejected == ["symbols"]
    assert hostrules.judge(df.limit(0)).count() == 0


def test_rates_are_shrunk_to_the_mean(spark):
    rows = [(h, good(j) + (" #" * 40 if j < h % 7 else "")) for h in range(40) for j in range(5 + h % 11)]
    df = spark.createDataFrame([(k, t, str(h)) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    rates, means = hostrules.host_rates(hostrules.measured(df, "text", F.col("source"), ["doc_id"]))
    n, f = Counter(h for h, _ in rows), Counter(h for h, t in rows if t.endswith("#"))
    total, failed = len(rows), sum(f.values())
    mean, spread = failed / total, sum(f[h] ** 2 / n[h] for h in n)
    between, within = (spread - failed * mean) / (len(n) - 1), (failed - spread) / (total - len(n))
    size = (total - sum(v * v for v in n.values()) / total) / (len(n) - 1)
    share = (between - within) / (between + (size - 1) * within)
    weight = (1 - share) / share
    assert 1 < weight < total and means["symbols"] == mean
    for r in rates.collect():
        h = int(r.host)
        assert r.symbols == pytest.approx((f[h] + mean * weight) / (n[h] + weight)) and min(f[h] / n[h], mean) <= r.symbols + 1e-12 <= max(f[h] / n[h], mean) + 1e-9


def mined(rows, anchors, positives, negs, low, high, scale):
    xs = [(k, i, lab, [math.floor(scale * x) for x in v]) for k, (i, lab, v) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, lab, v in xs:
        if not anchors(i):
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for q, j, m, w in xs if q != k and len(w) == len(v))
        for score, j, m in [x for x in near if x[2] == lab][:positives]:
            fit = [(-s, n) for s, n, x in near if x != lab and low * -score <= 100 * -s <= high * -score]
            out += [(i, j, r, n, -score, s) for r, (s, n) in enumerate(fit[:negs], 1)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_negatives_equal_brute_force(spark, parts, monkeypatch):
    """Over several blocks, with ties, copies, repeated ids, scores of 0, other lengths and rows that take no part."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 400 // parts)
    rng = random.Random(parts)
    rows = [(k % 350 if k != 5 else None, rng.randrange(3) if k % 50 else None, [float(rng.randrange(-2, 3)) for _ in range(3)]) for k in range(400)]
    rows += [(20, 1, [0.0, 0.0, 0.0]), (40, 1, [1.0]), (41, 1, [2.0]), (42, 2, [1.0]), (43, 0, []), (60, 0, []), (44, 0, [float("nan")] * 3), (45, 1, None), (46, 1, [None, 1.0, 1.0]), (80, 0, [1e30, 1.0, 0.0]), (81, 0, [1.0, 0.0, 0.0])]
    rows = [r for r in rows if r[2] is None or 1e30 not in r[2]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("x")).repartition(4)
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, positives=3, negatives=4, low=30, high=90, scale=4)
    want = mined(rows, lambda i: i % 20 == 0, 3, 4, 30, 90, 4)
    assert sorted(tuple(r) for r in got.collect()) == want and any(s == 0 for *_, s, _ in want)


def test_negatives_of_huge_vectors(spark):
    rows = [(0, 1, [1e6, 1.0]), (1, 1, [1e6, 2.0]), (2, 2, [6e5, 0.0]), (3, 2, [2e5, 0.0]), (4, 2, [5e5, 7.0])]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i == 0, 5, 10, 30, 90, 256)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_host_rules", "op13_hard_negatives"])
def test_whole_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = getattr(queries, name)(spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(db.execute(f"select {columns} from ({queries.ORACLES[name]})").fetchall())
