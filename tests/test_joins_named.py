"""Every join of a search says which side is sent to all tasks; no side that grows with the index is."""

import pytest
from pyspark.sql import functions as F

from textlode.operators import ordering, parse
from textlode.plans import questions, search


def _unnamed(df):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [line for line in lines if line.lstrip(" :+-").startswith("Join ")]
    assert joins
    return [line for line in joins if "strategy=" not in line]


@pytest.fixture
def whole(monkeypatch, spark, code):
    """An index, and plans that are not cut."""
    ix = search.build_index(code)
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: df)
    return ix


def test_searches_name_the_side_that_is_sent(spark, whole):
    asks = questions.asked(spark, ["who calls helper", "heap"])
    found, files = questions.search_questions(whole, asks)
    many = [f"w{i}x{i}y" for i in range(200)]  # more grams than are named in a filter
    named = {"symbols": found, "files": files, "combined": questions.combined(whole, asks), "enrichments": questions.enrichments(whole, questions.kinds(asks)),
             "callers": questions.callers(whole.edges, questions.kinds(asks), parse.first_definitions(whole.symbols)),
             "unified": search.unified_search(whole, "heap insert")[0], "code": search.code_search(whole, "heap", ["heap"], per_name=None),
             "functionality": search.functionality_search(whole, "heap", ["insert"], business=True),
             "grams": questions.code_lines(whole.gram_table, whole.line_table, spark.createDataFrame([(m,) for m in many], "term string"))}
    assert {k: _unnamed(df) for k, df in named.items()} == {k: [] for k in named}


def test_the_index_build_merges_texts(code):
    symbols = parse.symbol_table(parse.parse_symbols(code))
    lists = parse.call_lists(symbols, code.filter(F.length("content") > 0))
    assert _unnamed(symbols) == [] == _unnamed(lists)
