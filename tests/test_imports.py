"""Readers of folders and files: what is good is read, what is bad is told."""

import hashlib
import json

import pytest

from folioscope.sources import imports


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_notes(spark, tmp_path):
    head = lambda **x: "---\n" + json.dumps(x) + "\n---\n"
    put(tmp_path, "a.md", head(id="n1", title="One", tags=["x"]) + "body\n")
    put(tmp_path, "deep/er/b c+é.md", "no front matter")
    put(tmp_path, "deep/copy.md", head(id="n1", title="Copy") + "again")
    put(tmp_path, "bad.md", b"\xff\xfe broken")
    put(tmp_path, "worse.md", "---\n{oops\n---\nx")
    put(tmp_path, "blank.md", "\n")
    put(tmp_path, "empty.md", "")
    put(tmp_path, "other.txt", "not a note")
    got = {r.path: r for r in imports.notes(spark, str(tmp_path)).collect()}
    assert {p: (r.note_id, r.error) for p, r in got.items()} == {
        "a.md": ("n1", None), "deep/er/b c+é.md": ("deep/er/b c+é.md", None), "deep/copy.md": ("n1", "repeated id"), "bad.md": ("bad.md", "encoding"), "worse.md": ("worse.md", "malformed"), "blank.md": ("blank.md", None)
    }
    assert (got["a.md"].title, got["a.md"].tags, got["a.md"].body) == ("One", ["x"], "body\n") and got["a.md"].revision == hashlib.sha256((tmp_path / "a.md").read_bytes()).hexdigest()
    index = spark.createDataFrame([("n1", "a.md", got["a.md"].revision), ("blank.md", "old/blank.md", got["blank.md"].revision), ("gone", "gone.md", "r"), ("bad.md", "bad.md", "r")], "note_id string, path string, revision string")
    states = {r.note_id: r.state for r in imports.reconciled(imports.notes(spark, str(tmp_path)), index).collect()}
    assert states == {"deep/er/b c+é.md": "new", "blank.md": "changed", "gone": "missing", "bad.md": "missing"}


@pytest.mark.parametrize("block", ["128m", "64"])
def test_line_numbers_over_blocks(spark, tmp_path, block):
    want = {}
    for name, n in (("a.jsonl", 200), ("b.jsonl", 2), ("c.jsonl", 1)):
        lines = [f"{name} {k} " + "x" * (k % 30) if k % 7 else "" for k in range(n)]
        put(tmp_path, name, "\n".join(lines))
        want |= {(name, k + 1): t for k, t in enumerate(lines) if n > 1}  # an empty file has no lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {(r.file.rpartition("/")[2], r.line): r.text for r in imports.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_experiments(spark, tmp_path):
    good = {"format": "experiment-v1", "runId": "r1", "title": "t", "status": "completed", "task": "k", "model": "m"}
    many = {f"m{k}": 1 for k in range(51)}
    lines = [
        good, "{oops", "", good, good | {"runId": "r2", "aggregateMetrics": many}, good | {"runId": "r2"}, good | {"runId": "r2", "aggregateMetrics": many}, good | {"runId": "r3", "status": "done"}, [1], good | {"runId": "r4", "format": "x"},
        good | {"runId": "r5", "aggregateConfig": {"api_key": "x", "max_tokens": 5, "note": "Bearer " + "a" * 20, "ok": True}, "extra": {"deep": {"userPassword": 1, "list": [{"secret": 1}]}}},
        good | {"runId": "r6", "aggregateMetrics": {"a": True}}, good | {"runId": "r7", "codeCommit": "xyz"}, good | {"runId": "r8", "startedAt": "2024-01-01T00:00:00Z", "codeCommit": "abcdef0", "failureCategories": ["a"]}, '{"a": NaN}',
    ]
    put(tmp_path, "x.jsonl", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    put(tmp_path, "y.jsonl", json.dumps(good))
    got = {(r.file.rpartition("/")[2], r.line): r for r in imports.experiments(imports.numbered_lines(spark, str(tmp_path))).collect()}
    assert {k: r.error for (f, k), r in got.items() if f == "x.jsonl"} == {
        1: None, 2: "malformed JSON", 4: "repeated run", 5: "too many keys", 6: None, 7: "repeated run", 8: "status", 9: "no record", 10: "format", 11: None, 12: "aggregateMetrics", 13: "codeCommit", 14: None, 15: "malformed JSON"
    }
    assert got["x.jsonl", 11].sensitive == ["aggregateConfig.api_key", "aggregateConfig.note", "extra.deep.userPassword"] and got["y.jsonl", 1].error is None


def test_reference_items(spark, tmp_path):
    bare = {"key": "K1", "itemType": "book", "title": "T", "creators": [{"firstName": "A", "lastName": "B"}, {"name": "Org"}], "tags": [{"tag": "x"}], "DOI": "10.1/x"}
    put(tmp_path, "a.json", json.dumps([bare, {"key": "K2", "library": {"type": "group", "id": 7}, "data": {"key": "K2", "itemType": "note"}}, {"title": "no key"}, 5]))
    put(tmp_path, "b.json", '{"not": "a list"}')
    put(tmp_path, "c.json", "[broken")
    put(tmp_path, "d.json", "[]")
    got = {(r.path, r.turn): r for r in imports.reference_items(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in got.items()} == {("a.json", 0): None, ("a.json", 1): None, ("a.json", 2): "invalid item", ("a.json", 3): "invalid item", ("b.json", 0): "no list of items", ("c.json", 0): "no list of items"}
    one, two = got["a.json", 0], got["a.json", 1]
    assert (one.key, one.title, one.creators, one.tags, one.doi) == ("K1", "T", ["A B", "Org"], ["x"], "10.1/x") and (two.key, two.title, two.library, two.creators) == ("K2", "Untitled", "7", [])


def test_boards(spark, tmp_path):
    node = lambda i, **x: {"id": i, "type": "text", "text": f"t{i}", "x": 1, "y": 2.5, "width": 3, "height": 4} | x
    edge = lambda i, a, b: {"id": i, "fromNode": a, "toNode": b}
    put(tmp_path, "a.canvas", json.dumps({"nodes": [node("1"), node("2"), node("2"), node("3", x="far"), node("4", type="file"), node("")], "edges": [edge("e1", "1", "2"), edge("e2", "1", "3"), edge("e3", "1", None), edge("e4", "2", "9")]}))
    put(tmp_path, "b.canvas", "[]")
    put(tmp_path, "c.canvas", json.dumps({}))
    nodes, edges, errors = imports.boards(spark, str(tmp_path))
    assert sorted((r.path, r.id, r.y) for r in nodes.collect()) == [("a.canvas", "1", 2.5), ("a.canvas", "2", 2.5)]
    assert [(r.id, r.source, r.target) for r in edges.collect()] == [("e1", "1", "2")]
    assert sorted((r.path, r.what, r.id or "") for r in errors.collect()) == [
        ("a.canvas", "dangling edge", "e2"), ("a.canvas", "dangling edge", "e4"), ("a.canvas", "invalid edge", "e3"), ("a.canvas", "invalid node", ""), ("a.canvas", "invalid node", "3"), ("a.canvas", "invalid node", "4"),
        ("a.canvas", "repeated node", "2"), ("b.canvas", "malformed", ""),
    ]
