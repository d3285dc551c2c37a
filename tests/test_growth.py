"""What queries move and compute, beside their results: it must not grow with pairs, or with repeated work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import interchange
from folioscope.operators import citations, components, discovery, graph, layout, library, moves, results, within
from folioscope.plans import exchange as exchange_plans
from folioscope.plans import library as library_plans
from folioscope.plans import results as result_plans
from folioscope.plans import rules as rule_plans
from folioscope.plans import scholarly

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(spark, work):
    """Rows that the shuffles of ``work`` write."""
    jvm = spark.sparkContext._gateway
    store = spark._jsc.sc().statusStore()
    stages = lambda: [x.apply(k) for x in [store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)] for k in range(x.size())]
    before = {s.stageId() for s in stages()}
    out = work()
    return out, sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def test_common_terms_of_a_prefix_search_make_no_rows(spark):
    texts = {d: " ".join(["alpha", "beta", "gamma", f"rare{d % 40}x"]) for d in range(200)}
    asked = [(q, ["alp", "bet", "gam", f"rare{q}"]) for q in range(60)] + [(99, ["al", "zzz"]), (100, ["split", "parts"])]
    rows = [*texts.items(), (500, "split here"), (500, "parts there"), (None, "alpha beta")]
    docs, queries = spark.createDataFrame(rows, "page long, text string"), spark.createDataFrame(asked, "query long, terms array<string>")
    got, n = dealt(spark, lambda: {(r.query, r.page) for r in library.prefix_search(docs, queries).collect()})
    want = {(q, d) for q, terms in asked for d, t in texts.items() if all(any(w.startswith(x) for w in t.split()) for x in terms)} | {(100, 500)}
    assert got == want
    assert n < 200 * 60 / 3  # a row for each pair was 12,000


def test_words_and_their_positions_are_dealt_once(spark):
    df = library_plans.document_text_from_positions(spark, SF)
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_greater_word_stays_at_a_position(spark):
    index = spark.createDataFrame([(1, "b", [0, 2]), (1, "a", [0, 1, -1]), (1, "z", [9]), (2, "x", [7]), (3, None, [0]), (3, "y", [1])], "k long, word string, positions array<int>")
    assert {r.k: r.text for r in library.text_from_positions(index, "k", most=5).collect()} == {1: "b a b", 3: "y"}


def test_place_of_a_word_is_not_told_for_each_sentence(spark):
    # A filter on the sentence repeated the whole of it, with the pattern that finds the word inside the loop.
    assert plan(result_plans.document_example_sentences(spark, SF)).count("regexp_extract(") == 2
    assert plan(result_plans.document_example_sentences(spark, SF)).count("aggregate(") == 1


def test_scopes_that_share_a_list_are_told_alike(spark):
    lists, askers, subjects = result_plans.result_lists(spark, SF), result_plans.askers(spark, SF), result_plans.subjects(spark, SF)
    apart = results.ranked_results(result_plans.found(spark, SF))
    shared = results.ranked_results(lists, askers, "list")
    assert sorted(apart.collect()) == sorted(shared.collect())
    apart = results.recommended(result_plans.found(spark, SF).drop("query", "own_title", "own_doi"), subjects)
    shared = results.recommended(lists, subjects.withColumn("list", F.col("scope") % result_plans.LISTS), "list")
    assert sorted(apart.collect()) == sorted(shared.collect())


def test_moves_are_dealt_once_and_chains_followed_either_way(spark):
    df = spark.createDataFrame([(s, k, k, (k * 7 + s) % 31) for s in range(5) for k in range(31)], "scope long, key long, natural long, target long")
    told = moves.key_moves(df, "scope", "key", "natural", "target")
    assert plan(told).count("Exchange hashpartitioning") == 1
    want = {(r.scope, r.key, r.target + 1) for r in df.collect()}
    for few in (0, 1000):
        assert {tuple(r) for r in moves.moved(df, told, "scope", "key", "natural", few).collect()} == want
    assert moves._chains([1, 2, 3, 4, 5, 6], [None, 1, 4, 3, 9, 4]) == ([None, None, None, None, 9, None], [1, 2, None, None, 1, None])


def test_reference_lists_are_looked_for_once(spark):
    from folioscope.plans import quotes as quote_plans

    text = plan(quote_plans.customer_references(spark, SF))
    assert text.count("Generate") == 2 and "Union" not in text  # before, each kind of entry looked for the lists anew


def test_sections_are_not_joined(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 1, 2), (1, 1, 0), (1, 2, None), (1, 4, 1), (1, 5, 0), (2, 0, 3), (None, 0, 1), (None, 1, 0)]
    df = layout.open_sections(spark.createDataFrame(rows, "page long, ord int, level int"), "page", "ord", "level", 99)
    want = {(p, o, v, min((x - 1 for q, x, y in rows if p is not None and q == p and x > o and None not in (v, y) and y <= v), default=99)) for p, o, v in rows}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Join" not in plan(df)


def test_repeated_edges_are_not_held_whole(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3), (3, 3), (None, 4)], "a long, b long")
    out = graph.neighbourhood(df, spark.createDataFrame([(1,), (9,)], "node long"), hops=2)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)]
    assert "HashAggregate" not in plan(graph.neighbourhood(df, df.selectExpr("a as node").limit(0), hops=0)) and plan(graph.neighbourhood(df, df.selectExpr("a as node"), hops=1)).count("keys=[a#") == 0


def test_rows_without_a_hot_key_are_read_once(spark):
    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), "id")
    by = rows.groupBy("k").agg(F.min("id").alias("first"))
    out = components.looked_up(rows, by, "k", hot_rows=100)
    assert "Union" not in plan(out)  # before, rows were computed for hot keys and for others, also where no key was hot
    assert out.count() == 3000 and out.where("first <> k").isEmpty()
    assert "Union" in plan(components.looked_up(rows, by, "k", hot_rows=6))


def test_turns_of_components_deal_edges_twice(spark):
    links = spark.createDataFrame([(9, 5), (9, 5), (9, 2), (9, 7), (5, 2), (4, 3), (8, 4), (2, 9)], "a long, b long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a node goes on over batches
    try:
        out = components._streamed(links, components._smaller)
        assert plan(out).count("Exchange") == 1 and "Join" not in plan(out)
        assert sorted(map(tuple, out.collect())) == [(2, 9), (4, 3), (5, 2), (5, 2), (7, 2), (8, 4), (9, 2)]
        both = links.union(links.select("b", "a"))
        assert sorted(set(map(tuple, components._streamed(both, components._larger).collect()))) == [(4, 3), (5, 2), (8, 3), (9, 2), (9, 7)]
        got = {r.node: r.component for r in components.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {2: 2, 5: 2, 7: 2, 9: 2, 3: 3, 4: 3, 8: 3}


def test_feed_entries_are_parsed_once_and_shared_out(spark):
    assert "Exchange hashpartitioning" in plan(exchange_plans.part_feed(spark, SF))  # before, in as many tasks as the file had parts
    rows = [(1, "<entry><id>a</id><title>x <b>y</b> &amp; z</title><published>2001-02</published><title>no</title></entry>"), (2, "<feed/>"), (3, None)]
    out = spark.createDataFrame(rows, "k int, entry string").select("k", interchange.parsed_atom_entry(F.col("entry")).alias("x")).select("k", "x.*")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "x y & z", "", 2001), (2, "", "", "", None), (3, None, None, None, None)]


def test_experiment_lines_are_read_once(spark):
    out = exchange_plans.event_experiment_lines(spark, SF)
    assert "MapInArrow" not in plan(out)  # before, each line was read for the runs and again for its row
    own = "".join(r.error or "" for r in out.collect())
    assert "malformed JSON" in own and "repeated run" in own


def test_citation_keys_are_told_once(spark):
    rows = [(3, ["É Ünal"], 2020, "On the\nÜber work"), (1, ["é unal"], 2020, "A The"), (2, ["X ÜNAL"], 2020, "the"), (4, None, None, None), (5, [], None, "a"), (6, ["n"], 1, "one")]
    out = discovery.citation_keys(spark.createDataFrame([(*r, 7) for r in rows], "id long, authors array<string>, year int, title string, n int"), "id")
    assert "EvalPython" not in plan(out)  # before, normal forms were taken for each reader of the keys
    assert {r.id: r.citation_key for r in out.collect()} == {1: "unal2020the", 2: "unal2020the-2", 3: "unal2020the-3", 4: "paperndwork", 5: "paperndwork-5", 6: "n1one"}
    assert out.columns[-2:] == ["n", "citation_key"]


def test_texts_are_judged_once(spark):
    out = result_plans.benchmark_overlap_judge(spark, SF)
    assert "EvalPython" not in plan(out).split("benchmark")[-1] and plan(out).count("documents.parquet") == 0  # before, documents were read for each use of their terms


def test_lines_and_lists_of_citations_are_dealt_once(spark):
    df = scholarly.part_citation_edges(spark, SF)
    got, n = dealt(spark, lambda: {tuple(r) for r in df.collect()})
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "part"))
    assert got
    # Lines once, what cites once by either end, a row a node and back, a row a seed; before, lines twice and the rows of lists and edges again for each step.
    assert n < 4 * lines + parts * (citations.MOST_WORKS + 6)


def test_names_of_two_bytes_that_meet_are_told_apart(spark):
    short = spark.range(3000).select("id", citations._short(F.col("id")).alias("s"))
    a, b = short.groupBy("s").agg(F.min("id"), F.max("id").alias("b")).where("b > `min(id)`").select("min(id)", "b").first()
    lists = [(9001, 0, "references", k, w) for k, w in enumerate((a, 9002, 9003))] + [(None, 0, "references", 0, a)]
    references = [(9002, 0, b), (9002, 1, a), (9002, 2, 9001), (9003, 0, b)]
    out = citations.neighbourhood(spark.createDataFrame(lists, "seed long, list int, direction string, place long, work long"), spark.createDataFrame(references, "work long, place int, referenced long"))
    assert [tuple(r) for r in out[1].orderBy("turn").select("source", "target").collect()] == [(9001, a), (9001, 9002), (9001, 9003), (9002, a), (9002, 9001)]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_texts_that_stand_in_others(monkeypatch, block):
    monkeypatch.setattr(within, "BLOCK", block)
    rng = random.Random(block)
    some = lambda n: "".join(rng.choice("ab ñ\u4e00\U0001f600\0") for _ in range(n))
    texts = ["", *(some(rng.randrange(90)) for _ in range(60)), "", "ab" * 40]
    wanted = list({some(rng.randrange(1, 9)) for _ in range(300)} | {t[k : k + n] for t in texts for k, n in ((3, 16), (0, 17), (2, 40)) if len(t) > k} | {"ab" * 39 + "b", "ab" * 40 + "a", "a", "\0"})
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    rows, numbers = within.finder([(7 * k, w) for k, w in enumerate(wanted)])(data, offsets)
    assert sorted(zip(rows.tolist(), numbers.tolist())) == [(r, 7 * k) for r, t in enumerate(texts) for k, w in enumerate(wanted) if w in t]
    assert [len(x) for x in within.finder([])(data, offsets)] == [0, 0]


def test_documents_are_looked_at_once_for_parts_of_questions(spark):
    out = rule_plans.document_first_pages(spark, SF)
    # Before, a document stood beside each of its different runs of three characters: for long texts their square.
    assert plan(out).count("documents.parquet") == 1 and "Generate explode(array_distinct(regexp_extract_all(" not in plan(out)
    docs, asked = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    shared = discovery.first_pages_of_parts(docs.select("doc_id", "text"), asked, few=300)
    assert plan(shared).count("documents.parquet") > 1
    assert sorted(out.collect()) == sorted(shared.collect())
    assert discovery.first_pages_of_parts(docs.select("doc_id", "text"), asked.limit(0)).count() == 0
