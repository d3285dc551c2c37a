"""Every registered query against its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from folioscope import registry

SF = "/root/testdata/sf0.001"


def rows(table, names):
    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(cell(r[n]) for n in names) for r in table), key=repr)


def test_queries_without_sql_are_few():
    """Folds along a key, which have tests of their own."""
    folds = {"event_throttle", "event_cool_down", "event_budget_ledger", "event_lifecycle", "event_greedy_selection", "page_item_lines", "order_candidate_pools", "order_pooled_papers", "customer_order_moves", "document_reprinted_anchors", "benchmark_recommended", "document_sentences", "document_example_sentences", "document_without_furniture", "document_sentence_paragraphs"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == folds


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(registry.ORACLES[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in df.collect()]
    assert want and set(want[0]) == set(df.columns)
    assert rows(got, sorted(df.columns)) == rows(want, sorted(df.columns))
