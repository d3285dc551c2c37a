"""Running headers and footers against a plain loop; passages of questions and citation keys."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import interchange as I
from folioscope.operators import discovery, furniture, retrieval
from folioscope.operators.retrieval import ranked_passages
from folioscope.plans import rules

SF = "/root/testdata/sf0.001"


def fold(words):
    return [re.sub(r"[0-9]+", "#", w) for w in words]


def edge(pages, least, end):
    best, count = None, 0
    for size in range(16, 1, -1):
        seen = {}
        for words in pages:
            if len(words) > size:
                key = tuple(fold(words[-size:] if end else words[:size]))
                seen[key] = seen.get(key, 0) + 1
        for key, n in seen.items():
            if n >= least and n > count:
                best, count = list(key), n
    return best, count


def strip(words, run, end):
    while run and len(words) > len(run) and fold(words[-len(run) :] if end else words[: len(run)]) == run:
        words = words[: -len(run)] if end else words[len(run) :]
    return words


def cleaned(texts):
    if len(texts) < 3:
        return texts
    pages = [(t or "").split() for t in texts]
    for _ in range(3):
        least = max(3, -(-len(pages) * 3 // 10))
        first, last = edge(pages, least, False)[0], edge(pages, least, True)[0]
        pages = [strip(strip(w, first, False), last, True) for w in pages]
    return [" ".join(w) for w in pages]


@pytest.fixture(scope="module")
def books():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices("alpha beta gamma delta 12 7".split(), k=n))
    out = {}
    for book in range(12):
        pages = []
        for k in range(rng.choice([2, 4, 9, 15])):
            head = rng.choice([f"Journal VOL {k} | www ", f"Journal VOL {k} | www ", f"Journal VOL {k} | www Journal VOL {k} | www ", "Inner part ", ""])
            pages.append(head + say(rng.randrange(12)) + rng.choice(["", f" page {k} of {book}", f" note page {k} of {book}"]))
        out[book] = pages
    out[50] = ["Journal VOL 1"] * 5 + [None, "", "Journal VOL 2 Journal VOL 2"]
    out[51] = [f"same words {k}" for k in range(4)]
    return out


def test_furniture(spark, books):
    rows = [(b, k, t) for b, pages in books.items() for k, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "book long, page long, text string")
    got = {(r.book, r.page): r.body for r in furniture.without_furniture(df, "book", "page", "text").collect()}
    assert got == {(b, k): x for b, pages in books.items() for k, x in enumerate(cleaned(pages))}
    words = df.withColumn("words", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    runs = {(r.book, r.edge): (r.run, r.pages) for r in furniture.repeated_edges(words, "book", "page", "words").collect()}
    for b, pages in books.items():
        for end in (False, True):
            run, n = edge([(t or "").split() for t in pages], max(3, -(-len(pages) * 3 // 10)), end)
            assert runs.get((b, "end" if end else "start")) == (None if run is None else (run[::-1] if end else run, n))
    assert furniture.without_furniture(df.limit(0), "book", "page", "text").count() == 0


def test_furniture_of_a_whole_table(spark):
    import hashlib

    pages = {}
    for r in rules._printed(spark, SF).orderBy("doc_id").collect():
        pages.setdefault(r.source, []).append(r)
    want = {r.doc_id: hashlib.sha256(x.encode()).hexdigest() for own in pages.values() for r, x in zip(own, cleaned([r.text for r in own]))}
    assert {r.doc_id: r.body_sha256 for r in rules.document_without_furniture(spark, SF).collect()} == want


def test_passages_of_a_question(spark):
    """Parts in turn: the best of each part first, then their seconds, each passage once, eight at most."""
    docs = spark.createDataFrame([(k, f"Filler number {k}. Memory retrieval of agents {k} and clinical sequence models {k}." if k % 3 else f"A page on graph search {k}.") for k in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "memory retrieval? graph search and clinical models"), (2, "zzz")], "item_id long, text string")
    parts = {r.part: r.text for r in discovery.question_parts(asked.where("item_id = 1")).collect()}
    assert [parts[k] for k in range(4)] == ["memory retrieval? graph search and clinical models", "memory retrieval", "graph search", "clinical models"] and "search" in parts.values() and "search and" in parts.values()
    ranked = [[(r.page, r.chunk) for r in ranked_passages(docs, spark.createDataFrame([(0, parts[k])], "item_id long, text string")).orderBy("rank").collect()] for k in sorted(parts)]
    want = []
    for turn in range(5):
        for own in ranked:
            if turn < len(own) and own[turn] not in want:
                want.append(own[turn])
    got = discovery.question_passages(docs, asked).orderBy("item_id", "turn").collect()
    assert [(r.page, r.chunk) for r in got if r.item_id == 1] == want[:8] and not [r for r in got if r.item_id == 2]


def test_ranked_passages_keep_no_pairs(spark, monkeypatch):
    """What is written between grows with the queries, not with queries times passages."""
    docs = spark.createDataFrame([(k, f"common words of every text and word{k} " * 3) for k in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"common words of every text and word{k}") for k in range(20)], "item_id long, text string")
    kept, cut = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = ranked_passages(docs, asked).collect()
    assert {r.item_id: r.page for r in got if r["rank"] == 1} == {k: k for k in range(20)} and len(got) == 100
    assert max(df.count() for df in kept) <= 20 * 7


def test_plan_without_furniture_does_not_double(spark):
    """Rounds read the pages and small tables of runs; no round holds the plans of those before, and pages without a scope keep their words."""
    rows = [("s" if k % 3 else "t", k, f"Head {k} of Head {k} of all  {chr(97 + k % 26) * (k + 9)} own {chr(97 + k % 26) * (k + 4)} foot {k}") for k in range(30)] + [(None, 99, "Head 1 of  it"), ("u", 98, "Head 1 of  it")]
    out = furniture.without_furniture(spark.createDataFrame(rows, "source string, doc_id long, text string"), "source", "doc_id", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    body = {r.doc_id: r.body for r in out.collect()}
    assert len(body) == 32 and body[99] == "Head 1 of it" and body[98] == "Head 1 of  it" and body[4] == "eeeeeeeeeeeee own eeeeeeee"


def test_first_pages_of_all_parts(spark):
    """Short parts, single words and pairs are looked for as well as whole questions, inside words too."""
    docs = spark.createDataFrame([(1, "xalphax"), (2, "Alpha\n beta, gamma"), (3, None), (4, "beta gam a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta, gamma"), (2, "\n\na"), (3, None), (4, "nothing")], "item_id long, text string")
    parts = {(r.item_id, r.part): r.text for r in discovery.question_parts(asked).collect()}
    got = {(r.item_id, parts[r.item_id, r.part]): (r.page, r.pages) for r in discovery.first_pages_of_parts(docs, asked).collect()}
    assert got == {(1, "alpha beta, gamma"): (2, 1), (1, "alpha beta"): (2, 1), (1, "gamma"): (2, 1), (1, "alpha"): (1, 2), (1, "beta"): (2, 2), (2, "\n\na"): (1, 3)}


def test_blanks_around_parts_go_and_line_breaks_stay(spark):
    text = "\u00a0Alpha beta.\n, éand more \n?\tgamma and\u3000delta \n "
    asked = spark.createDataFrame([(1, text)], "item_id long, text string")
    db = duckdb.connect()
    db.execute("create table benchmark as select 1 item_id, ? as text", [text])
    want = db.execute(rules.ORACLES["benchmark_question_parts"]).fetchall()
    assert sorted(tuple(r) for r in discovery.question_parts(asked).collect()) == sorted(want)
    assert (1, 1, "Alpha beta.\n") in want


def test_first_pages(spark):
    docs = spark.createDataFrame([(1, "xone two  three fourx"), (2, "one two three four"), (3, None), (4, "two three\nfour"), (5, "One Two Three Four five")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, "two three four five"), (4, None), (5, "none of these words")], "item_id long, text string")
    assert {r.item_id: (r.page, r.pages) for r in discovery.first_pages(docs, asked).collect()} == {1: (1, 3), 3: (5, 1)}


def test_citation_keys_are_unique(spark):
    rows = [(5, ["Ana Müller", "B"], 2020, "On the Größe of things"), (9, ["X Muller"], 2020, "of The  rest"), (2, [], None, "a b"), (3, None, None, None), (7, ["É. Ünal-Öz"], 1999, "ﬁnal words"), (8, [" "], 2001, "w" * 100), (10, [" "], 2001, "w" * 100)]
    got = {r.id: r.citation_key for r in discovery.citation_keys(spark.createDataFrame(rows, "id long, authors array<string>, year int, title string"), "id").collect()}
    assert got == {5: "muller2020the", 9: "muller2020the-9", 2: "paperndwork", 3: "paperndwork-3", 7: "unaloz1999final", 8: "paper2001" + "w" * 63, 10: "paper2001" + "w" * 63 + "-10"}
    out = rules.order_bibtex(spark, SF)
    assert out.count() == out.select("citation_key").distinct().count()


def test_keyword_entries(spark):
    lines = ["- **TERM**: definition", "* **Two words:** told **so**", "3) **a** – b", "+ **a** - b", "- TERM: no", "**a**: no bullet", "- **a** no", "- ** **: x", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, t string").select("k", I.keyword_entry(F.col("t")).alias("e")).orderBy("k").collect()
    assert [r.e and tuple(r.e) for r in rows] == [("TERM", "definition"), ("Two words", "told **so**"), ("a", "b"), ("a", "b"), None, None, None, None, None]
