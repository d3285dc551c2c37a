"""Quotes found again, against plain loops and by example."""

import random
import unicodedata

import duckdb
import pytest

from folioscope.operators import beside, quotes
from folioscope.plans import quotes as plans

SF = "/root/testdata/sf0.001"


def where(text, quote):
    """The first place whose characters, spelled out and without blanks, begin with those of the quote."""
    if quote in text:
        return text.index(quote), text.index(quote) + len(quote)
    bare = lambda s: [(k, u) for k, c in enumerate(s) for u in unicodedata.normalize("NFKC", c) if not u.isspace() and u not in "\xad﻿"]
    page, wanted = bare(text), [u for _, u in bare(quote)]
    for k in range(len(page) - len(wanted) + 1):
        if wanted and [u for _, u in page[k : k + len(wanted)]] == wanted:
            return page[k][0], page[k + len(wanted) - 1][0] + 1
    return None


def test_located(spark):
    rng = random.Random(1)
    letters = ["a", "b", "ﬁ", "f", "i", " ", "\n", "\xad", "𝐀", "A", "😀", "ﷺ"]
    pages = {k: "".join(rng.choices(letters, k=rng.randrange(40))) for k in range(60)} | {90: "the ﬁrst re\xadlation here", 91: "", 92: None}
    asked = []
    for k, t in pages.items():
        for _ in range(5):
            at = rng.randrange(20)
            asked.append((k, "".join(c if rng.random() < 0.8 else rng.choice([" ", ""]) for c in (t or "")[at : at + rng.randrange(6)])))
    asked += [(90, "first relation"), (90, "first  relations"), (91, "x"), (92, "x"), (None, "x"), (90, None), (404, "x")]
    rows = spark.createDataFrame(asked, "page long, quote string")
    holders = spark.createDataFrame(list(pages.items()), "page long, text string")
    got = sorted((r.page if r.page is not None else -1, r.quote or "", r.location and (r.location.start, r.location.end)) for r in quotes.located(rows, holders, "page", "quote", "text").collect())
    want = sorted((k if k is not None else -1, q or "", None if k in (None, 404) or q is None else where(pages[k] or "", q)) for k, q in asked)
    assert got == want and (90, "first relation", (4, 18)) in got


def test_a_page_that_most_quotes_are_about(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, f"q{k}") for k in range(3000)], "page long, quote string")
    holders = spark.createDataFrame([(1, " ".join(f"q{k}x" for k in range(3000)))], "page long, text string")
    out = beside.told_beside(rows, holders, "page", ["quote"], lambda h: h["text"], lambda text, row: text.find(row["quote"]), "at", quotes.LOCATION["start"].dataType, most=200)
    assert out.where("at >= 0").count() == sum(1 for k in range(3000) if k % 3 or k == 1) and out.count() == 3000
    assert out.where("page <> 1 and at is not null").count() == 0


@pytest.mark.parametrize(
    ("text", "revision", "fragment", "want"),
    [
        ("근거 문장", "r", {}, ("resolved", None, 0, 5)),
        ("새 문장\n근거 문장", "s", {}, ("resolved", None, 5, 10)),
        ("근거 문장\n근거 문장", "s", {}, ("needs_repair", "ambiguous", None, None)),
        ("근거 문장\n앞: 근거 문장", "s", {"prefix": "앞: "}, ("resolved", None, 9, 14)),
        ("근거 문장 뒤\n근거 문장", "s", {"suffix": " 뒤"}, ("resolved", None, 0, 5)),
        ("다른 내용", "s", {}, ("needs_repair", "missing", None, None)),
        ("근거 문장", "s", {"block": "b1"}, ("needs_repair", "block_missing", None, None)),
        ("근거 문장<!-- block:b1 -->😀근거 문장<!-- block:b2 -->근거 문장", "s", {"block": "b1"}, ("resolved", None, 23, 28)),
        ("<!-- block:b1 --><!-- block:b1 -->근거 문장", "s", {"block": "b1"}, ("needs_repair", "ambiguous", None, None)),
        ("근거 문<!-- block:b1 -->장", "r", {"block": "b1"}, ("needs_repair", "missing", None, None)),
        ("aaa", "s", {"quote": "aa"}, ("needs_repair", "ambiguous", None, None)),
        (None, None, {}, ("needs_repair", "missing", None, None)),
    ],
)
def test_relocated(text, revision, fragment, want):
    row = {"block": None, "revision": "r", "quote": "근거 문장", "prefix": None, "suffix": None, "start": 0, "end": 5} | fragment
    got = quotes._relocated({"text": text, "revision": revision}, row, "<!-- block:{} -->")
    assert (got["status"], got["reason"], got["start"], got["end"]) == want


def test_relocated_in_text_that_repeats_itself_equals_its_sql(spark, tmp_path):
    """Places that overlap are one to the query; two that stand apart are ambiguous."""
    docs = [(2, "abc " * 40), (4, "abcdefgh" * 30), (5, "a" * 30), (7, "ab" * 20), (8, None), (10, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ--" * 2)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(plans.ORACLES["document_relocated_fragments"]).fetchall()
    got = plans.document_relocated_fragments(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.status for r in got} == {"resolved", "needs_repair"}


def test_reprinted(spark):
    """Of two places the nearer one; over a line's end two boxes; too far, too short, right already and elsewhere: none."""
    lines = [(1, 0, "A quoted passage", 0.0, 0.0, 160.0, 10.0), (1, 1, "of two lines; a quoted ", 0.0, 20.0, 230.0, 10.0), (1, 2, "PASSAGE again", 0.0, 40.0, 130.0, 10.0), (1, 3, None, 0.0, 60.0, 0.0, 10.0)]
    box = lambda x, y, w: {"x": x, "y": y, "width": w, "height": 10.0}
    asked = {
        "quoted passage": [box(30.0, 90.0, 90.0)], "passage of two": [box(0.0, 15.0, 70.0)], "quoted  PASSAGE": [box(20.0, 0.5, 140.0)], "two lines": [box(30.0, 500.0, 90.0)], "of": [box(0.0, 20.0, 20.0)], "nowhere at all": [box(0.0, 0.0, 9.0)], "A quoted": []
    }
    rows = spark.createDataFrame([(1, q, s) for q, s in asked.items()] + [(2, "two lines", [box(0.0, 0.0, 1.0)])], "page long, quote string, saved array<struct<x: double, y: double, width: double, height: double>>")
    out = quotes.reprinted(rows, spark.createDataFrame(lines, "page long, line int, text string, x double, y double, width double, height double"), "page")
    got = {(r.page, r.quote): r.boxes and [(b.x, b.y, b.width) for b in r.boxes] for r in out.collect()}
    assert got == {
        (1, "quoted passage"): [(160.0, 20.0, 70.0), (0.0, 40.0, 70.0)], (1, "passage of two"): [(90.0, 0.0, 70.0), (0.0, 20.0, 60.0)], (1, "quoted  PASSAGE"): None, (1, "two lines"): None, (1, "of"): None,
        (1, "nowhere at all"): None, (1, "A quoted"): None, (2, "two lines"): None,
    }


def test_reprinted_of_a_whole_table(spark):
    """Every found place prints the quote, within reach of the saved one; no quote that stands in reach is lost."""
    lines = {}
    for r in plans.printed_lines(spark, SF).collect():
        lines.setdefault(r.doc_id, {})[r.line] = r
    alone = lambda s: "".join(map(quotes.letters, s))
    kinds = set()
    saved = {(r.doc_id, r.line): r for r in plans.saved_anchors(spark, SF).collect()}
    for r in plans.document_reprinted_anchors(spark, SF).collect():
        own = saved[r.doc_id, r.line]
        wanted = alone(own.quote)
        drift = own.saved[0].y - lines[r.doc_id][r.line].y
        kinds.add(r.boxes is not None and r.boxes > 0)
        if r.boxes is not None and r.boxes > 0:
            assert wanted in alone("".join(lines[r.doc_id][k].text for k in sorted(lines[r.doc_id])))
            assert abs(r.y - own.saved[0].y) <= 160 and len(wanted) >= 4
        elif len(wanted) >= 4 and 1.5 < drift <= 100:
            assert False, (r, own)
    assert kinds == {True, False}
