"""Rules of a stream: the same as the folds over all events, also when the stream stops and starts again."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import ordered
from folioscope.streaming import decisions

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENT = "id long, who string, ts timestamp, kind string, token string, next string, ends timestamp, hit boolean, retry double"


@pytest.fixture(scope="module")
def events():
    """Events in order of time, as six files."""
    rng = random.Random(5)
    rows, tokens = [], {}
    for k in range(360):
        who = rng.choice("abcde") if k % 40 else None
        now = T0 + dt.timedelta(seconds=k * 7)
        had = tokens.setdefault(who, [])
        kind = "open" if not had else rng.choice(["renew"] * 12 + ["revoke", "open"])
        token = f"t{k}" if kind == "open" else rng.choice(had[-1:] * 9 + had[-2:-1] + ["none"]) if had else None
        after = f"t{k}" if kind == "renew" else None
        had.append(after or token)
        rows.append((k, who, now, kind, token, after, T0 + dt.timedelta(seconds=2000) if who == "e" else None, rng.random() < 0.2, rng.choice([None, 5.0, 90.0])))
    return [rows[k * 60 : (k + 1) * 60] for k in range(6)]


RULES = {
    "throttle": (ordered.throttle("ts", 30.0), T.BooleanType(), lambda s: s["last"] + 30 if "last" in s else None),
    "cool_down": (ordered.cool_down("ts", "hit", "retry"), T.BooleanType(), lambda s: s.get("until")),
    "renewal": (ordered.renewal("ts", "kind", "token", "next", "ends"), T.StringType(), None),
}


@pytest.mark.parametrize("rule", list(RULES))
def test_stream_equals_fold(spark, tmp_path, events, rule):
    step, kind, over = RULES[rule]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", decisions.ROCKSDB)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(parts):
        for rows in parts:
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        told = decisions.decided(stream, "who", "ts", "id", step, "said", kind, late="1 minute", over=over)
        query = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    run(events[:3])
    run(events[3:])  # a new query from the checkpoint of the one that ended
    every = spark.createDataFrame([r for part in events for r in part], EVENT)
    want = ordered.folded(every.where("who is not null"), "who", ["ts", "id"], dict, step, "said", kind)
    got = {r.id: r.said for r in spark.read.parquet(out).collect()}
    assert got == {r.id: r.said for r in want.collect()} and len(set(got.values())) > 1


def test_renewal_by_example():
    step = ordered.renewal("ts", "kind", "token", "next", "ends")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    state, say = {}, []
    for s, kind, token, after in [(0, "renew", "x", "y"), (1, "open", "a", None), (2, "renew", "a", "b"), (3, "renew", "q", "r"), (4, "renew", "b", "c"), (5, "renew", "a", "d"), (6, "renew", "c", "e"), (7, "open", "z", None), (8, "revoke", None, None)]:
        say.append(step(state, {"ts": at(s), "kind": kind, "token": token, "next": after, "ends": at(100)}))
    assert say == ["invalid", "opened", "renewed", "invalid", "renewed", "reuse", "invalid", "invalid", "invalid"]
    state = {}
    told = [step(state, {"ts": at(s), "kind": k, "token": t, "next": n, "ends": at(10)}) for s, k, t, n in [(0, "open", "a", None), (10, "renew", "a", "b")]]
    assert told == ["opened", "invalid"] and json.loads(json.dumps(state)) == state
    state = {"token": "a", "used": [str(k) for k in range(ordered.MOST_RENEWALS)], "until": None}
    assert step(state, {"ts": at(0), "kind": "renew", "token": "a", "next": "b", "ends": None}) == "invalid"


def test_memories(spark):
    rows = [(1, "d", "propose", 1), (2, "d", "accept", 1), (3, "d", "accept", 1), (4, "d", "forget", 1), (5, "d", "propose", 2), (6, "d", "create", 3), (7, "d", "invalidate", 3), (8, "d", "invalidate", 3),
            (9, "e", "propose", 4), (10, "e", "reject", 4), (11, "e", "propose", 5), (12, "e", "propose", 5), (13, "e", "invalidate", 9), (14, None, "propose", 6), (15, None, "accept", 6)]
    out = ordered.remembered(spark.createDataFrame(rows, "seq long, derived string, op string, record long"), "derived", ["seq"], "op", "record")
    assert [r.outcome for r in out.orderBy("seq").collect()] == [
        "pending", "accepted", "refused", "rejected", "suppressed", "accepted", "invalidated", "refused", "pending", "rejected", "pending", "refused", "refused", "pending", "accepted"
    ]


def test_pruned(spark):
    now = F.lit(T0)
    rows = [(1, T0 - dt.timedelta(days=d), r) for d, r in ((0, "a"), (30, "b"), (31, "c"), (40, "d"), (50, None))]
    conflicts = spark.createDataFrame([("c", "resolved"), ("d", "unresolved"), ("d", "unresolved"), (None, "unresolved")], "revision string, status string")
    got = ordered.pruned(spark.createDataFrame(rows, "note long, made timestamp, rev string"), conflicts, "made", "rev", now)
    assert sorted(r.rev for r in got.collect()) == ["a", "b", "d"]
