"""Result lists, recommendations, tiers and the overlap judge against plain loops."""

import random
import re

import pytest

from folioscope.operators import results as R

RESULT = "scope long, query string, own_title string, own_doi string, turn long, item long, title string, abstract string, doi string, citations long"


def normal(text):
    import unicodedata

    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


def subject(text):
    return list(dict.fromkeys(w for w in normal(text or "").split() if len(w) >= 3 and w not in R.COMMON_WORDS))


def topics(text):
    words = [w for w in normal(text or "").split() if len(w) >= 3 and w not in R.COMMON_WORDS]
    ordered = sorted(dict.fromkeys(words), key=lambda w: (-words.count(w), words.index(w)))
    twice = [w for w in ordered if words.count(w) > 1]
    return twice if len(twice) >= 2 else ordered


def held(text, terms):
    own = set(subject(text))
    return [t for t in terms if t in own][:4]


def recommended(doc, items):
    title = None if normal(doc["title"] or "") in ("", normal(re.sub(r"(?i)\.pdf$", "", doc["name"]))) or re.search(r"\btable\b", normal(doc["title"])) else doc["title"].strip()
    refs = [t.strip() for t in doc["references"] or [] if t and len(t.strip()) >= 8][:4]
    top = topics(doc["overview"])[:12]
    needed = [w for w in dict.fromkeys(subject(title) + top) if w not in R.GENERIC_WORDS and not w.isdigit()]
    terms = list(dict.fromkeys(subject(title) + top + [w for r in refs for w in subject(r)]))
    out, titles, dois = [], set(), set()
    for x in sorted(items, key=lambda x: x["turn"]):
        key, doi = normal(x["title"] or ""), (x["doi"] or "").strip().lower() or None
        if (doi and doi == (doc["doi"] or "").strip().lower()) or (title and key == normal(title)) or (doi and doi in dois) or key in titles:
            continue
        a, b = held(x["title"], terms), held(x["abstract"], terms)
        c = list(dict.fromkeys(t for r in refs for t in held(r, subject(x["title"]))))[:4]
        score = 3 * len(a) + len(b) + 2 * len(c)
        enough = len(a) >= 2 or (any(len(t) >= 8 for t in a) and b) or len(c) >= 2
        if not enough or (needed and not held(f"{x['title'] or ''} {x['abstract'] or ''}", needed)):
            continue
        titles.add(key)
        dois.add(doi)
        out.append((-score, -(x["citations"] if x["citations"] is not None else -1), (x["title"] or "").lower(), x["turn"], x["item"], score))
    return [(item, score) for *_, item, score in sorted(out)[:10]]


WORDS = "retrieval memory agents benchmark clinical the model neural Attention graph sequence language ﬁne tuning evaluation evidence 2024 study".split()


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = []
    for k in range(900):
        rows.append((k % 30, say(5), "x", None, k, k, rng.choice([say(rng.randrange(1, 6)), say(2), ""]), rng.choice([say(8), None]), rng.choice([None, f"10.1/{rng.randrange(30)}", f" 10.1/{rng.randrange(30)} "]), rng.choice([None, rng.randrange(9)])))
    docs = [(s, "a.pdf", rng.choice(["A", say(4), "Table of things", None]), rng.choice([None, "10.1/3"]), rng.choice([say(20), None, ""]), rng.choice([None, [say(4), "short", say(3), None]])) for s in range(30)]
    return rows, docs


def test_recommended(spark, lists):
    rows, docs = lists
    df = spark.createDataFrame(rows, RESULT).drop("query", "own_title", "own_doi")
    got = {}
    for r in R.recommended(df, spark.createDataFrame(docs, "scope long, name string, title string, doi string, overview string, references array<string>")).orderBy("scope", "place").collect():
        got.setdefault(r.scope, []).append((r.item, r.score))
    names = RESULT.replace(",", "").split()[::2]
    items = [dict(zip(names, r)) for r in rows]
    for s, name, title, doi, overview, references in docs:
        doc = {"name": name, "title": title, "doi": doi, "overview": overview, "references": references}
        assert got.get(s, []) == recommended(doc, [x for x in items if x["scope"] == s])
    assert len(got) > 5


def test_first_seen(spark, lists):
    rows, _ = lists
    want = []
    for s in range(30):
        seen = set()
        for r in (r for r in rows if r[0] == s):
            own = {(k, v) for k, v in (("title", r[6]), ("doi", r[8])) if v is not None}
            if not own & seen:
                seen |= own
                want.append(r[5])
    df = spark.createDataFrame(rows, RESULT)
    assert sorted(r.item for r in R.first_seen(df, "scope", ["turn"], ["title", "doi"]).collect()) == sorted(want)
    assert R.first_seen(df.limit(0), "scope", ["turn"], ["title"]).count() == 0


def test_a_dropped_row_claims_nothing(spark):
    rows = [(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "y"), (1, 4, None, None), (1, 5, None, None)]
    got = R.first_seen(spark.createDataFrame(rows, "s long, turn long, title string, doi string"), "s", ["turn"], ["title", "doi"])
    assert sorted(r.turn for r in got.collect()) == [1, 3, 4, 5]


def test_reading_tiers(spark):
    rng = random.Random(4)
    rows = [(s, k, rng.choice([0, 42, 60, 68, 87, 88, 96, 100]), rng.randrange(3)) for s in range(30) for k in range(s * 3)]
    want = []
    for s in range(30):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], -r[3], r[1]))
        n = len(own)
        left = {"deep_read": max(1, n * 5 // 100) if n >= 20 else 1, "skim": max(1, n * 15 // 100), "abstract_only": max(1, n * 25 // 100)}
        least = {"deep_read": 96 if n < 20 else 88, "skim": 68, "abstract_only": 42}
        for r in own:
            tier = next((t for t in left if left[t] and r[2] >= least[t]), "pass")
            if tier != "pass":
                left[tier] -= 1
            want.append((r[0], r[1], tier))
    got = R.reading_tiers(spark.createDataFrame(rows, "s long, id long, score int, sure int"), "s", "score", "sure", "id")
    assert sorted((r.s, r.id, r.tier) for r in got.collect()) == sorted(want) and len({t for *_, t in want}) == 4


def test_overlap_judge(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(40)] + ["the", "of"]
    asked = [(k, " ".join(rng.sample(words, rng.randrange(1, 9)))) for k in range(30)] + [(98, ""), (99, None)]
    records = [(k, " ".join(rng.choices(words, weights=[30, 30, 30] + [1] * 39, k=rng.randrange(25)))) for k in range(200)] + [(900, "filler " * 3000 + asked[0][1]), (901, None)]
    terms = lambda t: {w for w in (t or "").split() if len(w) > 3}
    want = {}
    for q, t in asked:
        for r, text in records:
            n, hits = len(terms(t)), len(terms(t) & terms(text))
            if n and 4 * hits >= n:
                want[q, r] = 2 if 2 * hits >= n else 1
    got = R.overlap_judged(spark.createDataFrame(asked, "query long, text string"), spark.createDataFrame(records, "record long, text string"))
    assert {(r.query, r.record): r.score for r in got.collect()} == want and (0, 900) in want
