"""Pools, citation neighbourhoods and moves against plain loops."""

import itertools
import random

import duckdb
import pytest

from folioscope.operators import citations, components, moves, pools
from folioscope.plans import scholarly

SF = "/root/testdata/sf0.001"
CANDIDATE = "arrival long, source string, title string, doi string, arxiv string, s2 string, openalex string, authors array<string>, year int, venue string, abstract string, citations long"


def loop(rows):
    """The pool of each candidate and the identifiers of each pool, one candidate after the other."""
    alias, papers, out = {}, {}, {}

    def keys(p):
        return [f"{k}:{v}" for k, v in (("doi", p["doi"]), ("arxiv", p["arxiv"] or p["doi_arxiv"]), ("s2", p["s2"]), ("openalex", p["openalex"]), ("title", p["title_key"])) if v]

    for r in sorted(rows, key=lambda r: r["arrival"]):
        pool = next((alias[k] for k in keys(r) if k in alias), None)
        if pool is None:
            pool = r["arrival"]
            papers[pool] = dict(r)
        else:
            own = papers[pool]
            doi = own["doi"] or r["doi"]
            told = own["doi_arxiv"] if own["doi"] else r["doi_arxiv"]
            papers[pool] = own | {"doi": doi, "doi_arxiv": told, "arxiv": own["arxiv"] or r["arxiv"] or told, "s2": own["s2"] or r["s2"], "openalex": own["openalex"] or r["openalex"]}
        for k in keys(papers[pool]):
            alias[k] = pool
        out[r["arrival"]] = pool
    return out, papers


def found(rng, n, names, hot=0.0):
    some = lambda share, make: make() if rng.random() < share else None
    out = []
    for k in range(n):
        doi = some(0.6, lambda: rng.choice([f"10.1/{rng.randrange(names)}", f"https://doi.org/10.48550/arXiv.2401.{rng.randrange(names):05d}"]))
        doi = "10.1/hot" if rng.random() < hot else doi
        title = rng.choice([f"A Title of some length {rng.randrange(names)}", f"Ａ　title of SOME length {rng.randrange(names)}", "Short", "", None])
        out.append((k * 3 + 1, rng.choice("ab"), title, doi, some(0.4, lambda: f"arXiv:2401.{rng.randrange(names):05d}v2"), some(0.3, lambda: f"s{rng.randrange(names)}"), some(0.3, lambda: f"W{rng.randrange(names)}"),
                    some(0.5, lambda: ["x"] * rng.randrange(3)), some(0.5, lambda: rng.randrange(2000, 2024)), some(0.7, lambda: rng.choice(["", "V1", "V2"])), some(0.7, lambda: "y" * rng.randrange(5)), some(0.6, lambda: rng.randrange(50))))
    return out


@pytest.mark.parametrize(("names", "hot", "hot_rows"), [(400, 0.0, 10**6), (60, 0.0, 10**6), (300, 0.4, 40)])
def test_pools(spark, names, hot, hot_rows):
    rows = found(random.Random(names), 300, names, hot)
    df = spark.createDataFrame(rows, CANDIDATE)
    plain = [r.asDict() for r in pools.identified(df).collect()]
    want, papers = loop(plain)
    got = pools.pooled(df, hot_rows).cache()
    assert {r.arrival: r.pool for r in got.select("arrival", "pool").collect()} == want
    told = {r.pool: r for r in pools.pooled_papers(got).collect()}
    assert set(told) == set(papers) and [told[p].id for p in sorted(told)] == [f"p{k + 1}" for k in range(len(told))]
    for pool, paper in papers.items():
        members = sorted((r for r in plain if want[r["arrival"]] == pool), key=lambda r: r["arrival"])
        first = lambda c, own=members: next((r[c] for r in own if r[c] not in (None, "", [])), None)
        longest = max((r["abstract"] for r in members if r["abstract"]), key=len, default=None)
        r = told[pool]
        assert (r.members, r.title, r.authors, r.year, r.venue, r.abstract) == (len(members), members[0]["title"], first("authors"), first("year"), first("venue"), longest)
        assert r.citations == max((m["citations"] for m in members if m["citations"] is not None), default=None)
        assert (r.doi, r.arxiv, r.s2, r.openalex) == tuple(paper[c] for c in ("doi", "arxiv", "s2", "openalex"))


def test_keys_bridge_pools_without_joining_them(spark):
    """The third has the DOI of the first and the title of the second; the fourth has that title only."""
    rows = [(1, "10.1/A", "Something entirely else"), (2, None, "A paper with a title"), (3, "10.1/a", "A paper with a title"), (4, None, "a paper with a  TITLE"), (5, None, None)]
    df = spark.createDataFrame([(a, "s", t, d, *[None] * 8) for a, d, t in rows], CANDIDATE)
    assert {r.arrival: r.pool for r in pools.pooled(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    assert pools.pooled(df.limit(0)).count() == 0


def test_copies_are_one_pool(spark):
    rows = [(k, "s", "One title for all of them", "10.48550/arXiv.2401.00001", *[None] * 8) for k in range(200)]
    (r,) = pools.pooled_papers(pools.pooled(spark.createDataFrame(rows, CANDIDATE), 20)).collect()
    assert (r.id, r.pool, r.members, r.arxiv) == ("p1", 0, 200, "2401.00001")


def test_pools_of_a_whole_table(spark):
    rows = [r.asDict() for r in pools.identified(scholarly.candidates(spark, SF)).collect()]
    want, papers = loop(rows)
    assert {r.o_orderkey: r.pool for r in scholarly.order_candidate_pools(spark, SF).collect()} == want
    assert len(papers) < len(rows)
    assert {r.pool: (r.doi, r.arxiv) for r in scholarly.order_pooled_papers(spark, SF).collect()} == {p: (x["doi"], x["arxiv"]) for p, x in papers.items()}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7), (None, 3)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), hot_rows=50).collect()}
    assert got == {x: root(x) for x in list(up)}


def around(seed, lists, references, most, most_edges):
    """One seed's graph: lists in turn while places are left, then what is shown already, then references."""
    cut = [list(works[:most]) for works in lists.values()]
    names, seen, shown, edges, taken = list(lists), [set() for _ in cut], [seed], {}, 0

    def include(name, work):
        nonlocal taken
        if work not in shown:
            if taken >= most:
                return
            shown.append(work)
            taken += 1
        ends = (work, seed) if name == "cited_by" else (seed, work)
        edges.setdefault((*ends, name == "related"), name)

    going = True
    while going and taken < most:
        going = False
        for k, name in enumerate(names):
            work = next((w for w in cut[k] if w not in seen[k]), None)
            if work is not None:
                seen[k].add(work)
                going = True
                include(name, work)
    for k, name in enumerate(names):
        for work in cut[k]:
            if work not in seen[k]:
                seen[k].add(work)
                if work in shown:
                    include(name, work)
    for work in shown:
        for other in references.get(work, []):
            if other in shown:
                edges.setdefault((work, other, False), "references")
    return shown, [(a, b, name) for (a, b, _), name in edges.items()][:most_edges]


@pytest.mark.parametrize(("most", "most_edges"), [(5, 180), (9, 12), (1, 3)])
def test_citation_neighbourhood(spark, most, most_edges):
    rng = random.Random(most)
    refs = {w: rng.sample(range(40), rng.randrange(12)) for w in range(40)}
    seeds = {s: {"references": rng.choices(range(40), k=rng.randrange(30)), "cited_by": rng.choices(range(40), k=rng.randrange(4)), "related": rng.choices(range(40), k=rng.randrange(30))} for s in range(12)}
    seeds[12] = {"references": [12, 12, 3], "cited_by": [3, 3], "related": []}
    rows = [(s, k, name, place, w) for s, lists in seeds.items() for k, (name, works) in enumerate(lists.items()) for place, w in enumerate(works)]
    nodes, edges, directions = citations.neighbourhood(
        spark.createDataFrame(rows, "seed long, list int, direction string, place long, work long"),
        spark.createDataFrame([(w, p, r) for w, own in refs.items() for p, r in enumerate(own)], "work long, place int, referenced long"), most, most_edges,
    )
    nodes, edges = ([tuple(r) for r in x.orderBy("seed", "turn").collect()] for x in (nodes, edges))
    for seed, lists in seeds.items():
        if any(lists.values()):
            shown, known = around(seed, lists, refs, most, most_edges)
            assert [n for s, n, _ in nodes if s == seed] == shown
            assert [(a, b, d) for s, a, b, d, _ in edges if s == seed] == known
    assert all(r.shown <= min(r.total, most) and r.truncated == (r.total > r.shown) for r in directions.collect())


def longest(ranks):
    return max((len(c) for n in range(len(ranks) + 1) for c in itertools.combinations(ranks, n) if list(c) == sorted(c)), default=0)


def test_moves_are_fewest_and_lead_back(spark):
    rng = random.Random(2)
    rows = []
    for scope in range(40):
        n = rng.randrange(1, 10)
        target = list(range(n))
        for _ in range(rng.randrange(4)):
            target.insert(rng.randrange(n), target.pop(rng.randrange(n)))
        rows += [(scope if scope else None, f"k{v}", v, place) for place, v in enumerate(target)]
    big = list(range(5000))
    for _ in range(300):
        big.insert(rng.randrange(5000), big.pop(rng.randrange(5000)))
    rows += [(99, f"k{v:05d}", v, place) for place, v in enumerate(big)]
    df = spark.createDataFrame(rows, "scope long, key string, natural long, target long")
    told = moves.key_moves(df, "scope", "key", "natural", "target").cache()
    by = {}
    for r in told.collect():
        by.setdefault(r.scope, []).append(r)
    for scope in range(40):
        own = sorted((r for r in rows if r[0] == (scope or None)), key=lambda r: r[3])
        assert len(by.get(scope or None, [])) == len(own) - longest([r[2] for r in own])
        after = {r[1]: p for p, r in zip([None, *(r[1] for r in own)], own)}
        assert all(after[m.key] == m.after for m in by.get(scope or None, []))
    assert 0 < len(by[99]) <= 300
    placed = moves.moved(df.where("scope is not null"), told, "scope", "key", "natural").join(df, ["scope", "key"])
    assert placed.where("place <> target + 1").count() == 0 and placed.count() == df.where("scope is not null").count()
    assert moves.key_moves(df.limit(0), "scope", "key", "natural", "target").count() == 0


def test_moves_that_do_not_fit(spark):
    """A missing key, a missing anchor, a circle and a chain."""
    df = spark.createDataFrame([(1, k, p) for p, k in enumerate("abcdefg")], "scope long, key string, natural long")
    told = spark.createDataFrame([(1, "z", "a"), (1, "b", "nobody"), (1, "c", "d"), (1, "d", "c"), (1, "a", "g"), (1, "e", "a")], "scope long, key string, after string")
    got = [r.key for r in moves.moved(df, told, "scope", "key", "natural").orderBy("place").collect()]
    assert got == ["f", "g", "a", "e", "b", "c", "d"]
    assert [r.key for r in moves.moved(df, told.limit(0), "scope", "key", "natural").orderBy("place").collect()] == list("abcdefg")


def test_related_parts_of_one_kind_are_not_paired(spark, tmp_path):
    """The lists of parts that are all of one type and size grow with the parts; their sizes are told, and repeated parts count."""
    parts = [(k, "T", 1) for k in range(200)] + [(5, "T", 1), (900, "T", 2), (901, None, 1), (902, None, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, k, k % 7) for k in range(30)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    lists = scholarly._part_graph(spark, str(tmp_path))[0]
    assert lists.where("list = 2").count() <= len(parts) * (citations.MOST_WORKS + 2)
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("part_citation_nodes", "part_citation_directions"):
        df = scholarly.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(db.execute(f"select {','.join(df.columns)} from ({scholarly.ORACLES[name]})").fetchall())


def test_odd_lines_cite_as_in_sql(spark, tmp_path):
    """Lines that repeat a number, lines without an order, a number or a part, and gaps."""
    rng = random.Random(4)
    lines = [(rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 2, 3, 4, 6]), rng.choice([None, *range(12)])) for _ in range(500)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "T", k % 2) for k in range(12)], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("part_citation_nodes", "part_citation_edges", "part_citation_directions"):
        df = scholarly.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(db.execute(f"select {','.join(df.columns)} from ({scholarly.ORACLES[name]})").fetchall(), key=repr)
