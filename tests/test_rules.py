"""Rules that SQL cannot say, against plain loops; text and entity functions on odd input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import entity as E
from folioscope.functions import interchange as I
from folioscope.functions import text as X
from folioscope.operators import graph, layout, ordered, records, store

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4) if k % 19 else None, T0 + dt.timedelta(seconds=rng.randrange(600)), rng.choice(["reserve", "commit", "release"]), float(rng.randrange(40)) if k % 7 else None) for k in range(300)]
    rows += rows[:5]  # repeated rows
    return rows, spark.createDataFrame(rows, "id long, who long, ts timestamp, kind string, amount double")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0])):  # rows without a key are a group
        out.setdefault(r[1], []).append(r)
    return out


def test_throttle(events):
    rows, df = events
    want = []
    for own in by_key(rows).values():
        last = None
        for r in own:
            kept = last is None or (r[2] - last).total_seconds() >= 30
            last = r[2] if kept else last
            want.append((r[0], kept))
    got = [(r.id, r.kept) for r in ordered.throttled(df, "who", "ts", "id").collect()]
    assert sorted(got) == sorted(want) and {k for _, k in want} == {True, False}
    assert ordered.throttled(df.limit(0), "who", "ts", "id").count() == 0


def test_cool_down(events):
    rows, df = events
    want = []
    for own in by_key(rows).values():
        until = None
        for r in own:
            asked = until is None or r[2] >= until
            if asked and r[3] == "release":
                until = r[2] + dt.timedelta(seconds=max(20.0, r[4] or 0.0))
            want.append((r[0], asked))
    got = ordered.cooled_down(df.withColumn("hit", F.col("kind") == "release"), "who", "ts", "id", "hit", "amount")
    assert sorted((r.id, r.asked) for r in got.collect()) == sorted(want)


def test_ledger(events):
    rows, df = events
    want = []
    for own in by_key(rows).values():
        spent = held = 0.0
        for r in own:
            x = r[4] or 0.0
            if r[3] == "reserve":
                verdict = "reserved" if spent + held + x <= 60 else "refused"
                held += x if verdict == "reserved" else 0
            else:
                x = min(x, held)
                held -= x
                spent += x if r[3] == "commit" else 0
                verdict = {"commit": "committed", "release": "released"}[r[3]]
            want.append((r[0], verdict))
    got = ordered.budget_ledger(df, "who", ["ts", "id"], "kind", "amount", 60.0).collect()
    assert sorted((r.id, r.verdict) for r in got) == sorted(want) and len({v for _, v in want}) == 4


def test_lifecycle(spark):
    steps = ["accept", "propose", "propose", "accept", "invalidate", "propose", "reject", "propose", "accept"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(steps)], "key long, at int, kind string")
    got = [r.state for r in ordered.lifecycle(df, "key", ["at"], "kind").orderBy("at").collect()]
    assert got == ["none", "pending", "pending", "accepted", "invalidated", "pending", "rejected", "rejected", "rejected"]


def test_greedy_selection(spark):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.randrange(20), rng.randrange(1, 400)) for k in range(90)]
    got = ordered.greedy_selection(spark.createDataFrame(rows, "s long, id long, score int, cost int"), "s", "score", "id", "cost").collect()
    for s, chosen in got:
        spent, want = 0, []
        for _, k, _, cost in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))[:64]:
            if len(want) < 8 and spent + cost <= 1000:
                spent += cost
                want.append(k)
        assert chosen == want


def test_ranked_values(spark):
    rng = random.Random(7)
    values = {"a": [rng.randrange(50) for _ in range(501)], "b": [7] * 400, "c": [3, 1]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    out = ordered.ranked_values(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"upper": lambda n: F.floor(n / 2) + 1, "first": lambda n: F.lit(1)})
    assert {r.k: (r.upper, r.first) for r in out.collect()} == {k: (sorted(vs)[len(vs) // 2], min(vs)) for k, vs in values.items()}


def test_ranked(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.randrange(30))) for k in range(500)]
    got = {r.k: r.place for r in store.ranked(spark.createDataFrame(rows, "k long, v double"), "v", "k").collect()}
    assert got == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_neighbourhood_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 400)] + [(1, 500), (500, 501), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    out = graph.neighbourhood(df, spark.createDataFrame([(0,), (501,), (999,)], "node long"), most=10).collect()
    assert sorted((r.node, r.hop) for r in out if r.seed == 0) == [(0, 0), *((k, 1) for k in range(1, 10))]
    assert sorted((r.hop, r.node) for r in out if r.seed == 501) == [(0, 501), (1, 500), (2, 1), (3, 0)]
    assert [r.node for r in out if r.seed == 999] == [999]


def test_three_way_rules(spark):
    side = lambda **rows: spark.createDataFrame(list(rows.items()), "k string, v string")
    base, current, incoming = side(a="1", b="1", c="1", d="1", e="1"), side(a="1", b="2", c="1", e="1", f="9"), side(a="2", b="3", d="1", g="7")
    got = {r.k: r.v for r in store.merged_records(base, current, incoming, "k", ["v"]).collect()}
    # a changed there, b changed in both: incoming wins; c and e are gone there and unchanged here; d went here; f and g are new.
    assert got == {"a": "2", "b": "3", "f": "9", "g": "7"}


def test_extrema_of_text_labels(spark):
    rows = [("x", 2.0, "b"), ("x", 2.0, "a"), ("x", 1.0, "c"), ("y", 1.0, "z"), ("x", None, "q")]
    (got,) = records.extrema(spark.createDataFrame(rows, "by string, v double, l string"), "by", "v", "l").collect()
    assert (got["values"], got.largest_at, got.smallest_at) == (3, "a", "c")


def test_text_functions(spark):
    texts = ["Abc  d", "ab", "", None, "   ", "x\U0001f600yz", "word " * 400]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", X.trigrams(F.col("t")).alias("g"), X.tokens(F.col("t")).alias("w"), X.chunks(F.col("t")).alias("c"), X.snippet(F.col("t"), F.array(F.lit("d"))).alias("s")).orderBy("k").collect()
    assert rows[0].g == ["abc", "bcd"] and rows[0].w == ["abc"] and rows[0].c == ["Abc d"]
    assert rows[1].g == [] and rows[2].g == [] and rows[3].g is None and rows[3].w is None and rows[4].c == []
    assert rows[5].g == ["x\U0001f600y", "\U0001f600yz"]
    assert len(rows[6].c) == 3 and rows[6].s.endswith("…") and not rows[6].s.startswith("…")


def test_identifiers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(E.doi(F.lit(" DOI: 10.5555/Ab.C, "))) == "10.5555/ab.c" and one(E.doi(F.lit("11.5/x"))) is None and one(E.doi(F.lit(None).cast("string"))) is None
    assert one(E.arxiv_id(F.lit("https://arxiv.org/pdf/2401.00001v3.pdf"))) == "2401.00001" and one(E.arxiv_id(F.lit("24.1"))) is None
    assert one(E.flipped_name(F.lit("Doe, Ann"))) == "Ann Doe" and one(E.flipped_name(F.lit("Doe,"))) == "Doe,"
    assert one(E.url_key(F.lit("HTTPS://www.Ex.org/A/?utm_source=x&b=1#f"))) == "ex.org/A/?&b=1"
    assert one(X.expanded_numbers(F.lit("3, 5-7; 7, 900-1200, 9-8, x, 12"))) == ["3", "5", "6", "7", "12"]
    assert one(E.token_estimate(F.lit(None).cast("string"))) == 1


def test_front_matter_of_odd_notes(spark):
    df = spark.createDataFrame([("---\n{}\n---\nx",), ("---\n[1]\n---\n",), ("plain",), (None,), ("",)], "n string")
    head, body, fault = I.parsed_front_matter(F.col("n"))
    got = [(r.b, r.f) for r in df.select(body.alias("b"), fault.alias("f")).collect()]
    assert got == [("x", None), ("", "malformed"), ("plain", "missing"), (None, None), ("", "missing")]


def test_lines_of_items(spark):
    rng = random.Random(9)
    rows = [(p, k, float(rng.randrange(300)), float(rng.randrange(5) * 10), 20.0, 12.0) for p in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "page long, ord int, x double, y double, width double, height double")
    want = {}
    for p in range(3):
        lines = []
        for _, k, x, y, w, h in (r for r in rows if r[0] == p):
            for n, own in enumerate(lines):
                _, _, lx, ly, lw, lh = own[-1]
                if abs((y + h / 2) - (ly + lh / 2)) <= 0.5 * min(h, lh) and x >= lx + lw - 1:
                    break
            else:
                n = len(lines)
                lines.append([])
            lines[n].append((p, k, x, y, w, h))
            want[p, k] = n
    assert {(r.page, r.ord): r.line for r in layout.lines_of_items(df, "page").collect()} == want
    assert layout.lines_of_items(df.limit(0), "page").count() == 0
