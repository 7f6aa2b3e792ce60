"""Whole search plans on a small corpus, and properties of physical plans."""

import pytest
from pyspark.sql import functions as F

from textlode.operators import grep, index, joins, rank
from textlode.plans import models, scope, search


@pytest.fixture(scope="module")
def ix(spark, code):
    return search.build_index(code)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_hits_do_not_pass_the_driver(spark, code):
    from textlode.plans import questions
    terms = spark.createDataFrame([("helper",)], "term string")
    lines = questions.code_lines(index.positioned_trigrams(code), index.line_starts(code), terms)
    assert "SortMergeJoin" in lines._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["line"]) for r in lines.collect()} == {("src/heap/heapam.c", n) for n in (6, 10, 13)}


def test_gram_postings_are_made_in_their_rows(spark):
    df = spark.createDataFrame([("a", "abcabcab", 1), ("b", "ab", 2), ("c", "x   y", 3)], "path string, content string, ord long")
    posts = index.positioned_trigrams(df)
    rows = [(r["path"], r["tri"], r["positions"]) for r in posts.orderBy("path", "tri").collect()]
    assert rows == [("a", "abc", [0, 3]), ("a", "bca", [1, 4]), ("a", "cab", [2, 5]), ("c", "  y", [2]), ("c", "x  ", [0])]
    assert [r["positions"] for r in index.positioned_trigrams(df, 1).filter("tri = 'abc'").collect()] == [[0]]
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()


def test_unified_search_first_leg_wins(ix):
    symbols, files = search.unified_search(ix, "heap_insert")
    got = {r["name"]: (r["match_source"], r["match_score"]) for r in symbols.collect()}
    assert got["heap_insert"] == ("concept_file", 95.0)  # the file is named after a term; later exact match does not raise it
    assert files.filter("leg = 0").first()["path"] == "src/heap/heapam.c"


def test_scope_ranking_and_filter(spark, code):
    found = {r["path"]: r for r in scope.matching_files(code, "helper heap").collect()}
    # 50 + 6 * log2(hits + 1) per term, later terms add 15, the name prefix adds 30
    assert found["src/heap/heapam.c"]["score"] == 62 + 15 + 30 and found["src/heap/heapam.c"]["selected"]
    s = scope.Scope()
    scope.run_command(s, "/grep helper", code)
    assert s.active and s.files(code).count() == s.paths.count()
    scope.run_command(s, "/ungrep", code)
    assert not s.active and s.files(code).count() == 3


def test_literal_search_has_no_python_and_one_exchange_at_most(code):
    plan = plan_of(grep.search_literal(code, "heap"))
    assert "Python" not in plan and "ArrowEval" not in plan and plan.count("Exchange") <= 1


def test_native_operators_stay_in_the_jvm(code):
    docs = index.plain_feed(code)
    for df in (rank.search_documents(docs, "heap tuple"), grep.call_sites(code), index.positioned_trigrams(code)):
        assert "Python" not in plan_of(df)
    assert "CartesianProduct" not in plan_of(rank.search_documents(docs, "heap tuple"))


def test_bucketed_range_join_equals_brute_force(spark):
    sym = spark.range(200).select(F.lit("f").alias("file"), (F.col("id") * 3).cast("int").alias("line"), F.col("id").alias("ord"), F.col("id").alias("key"))
    hits = spark.createDataFrame([("f", n) for n in (1, 50, 51, 52, 300, 599, 700)], "path string, line int")
    got = {(r["line"], r["symbol"]["key"]) for r in joins.symbols_near(hits, sym, 50).collect()}
    assert got == {(h, k) for h in (1, 50, 51, 52, 300, 599, 700) for k in range(200) if abs(k * 3 - h) <= 50}


def test_model_hook(spark):
    df = spark.createDataFrame([("p",), (None,)], "prompt string")
    broken = lambda p: 1 / 0
    got = [r["answer"] for r in models.with_completion(df, "prompt", complete=models.with_fallback(broken, lambda p: p + "!")).collect()]
    assert got == ["p!", None]


def test_scans_do_not_grow_with_terms(code):
    from textlode.plans import scope, search
    scans = lambda df: plan_of(df).count("Scan ")
    few, many = ["heap"], ["heap", "insert", "tuple", "page", "helper", "static"]
    for run in (lambda t: grep.search_literals(code, t, 5), lambda t: grep.keyword_search(code, t, 5, 9), lambda t: scope.text_scores(code, t),
                lambda t: search.topic_search(code, " ".join(t))):
        assert scans(run(many)) <= scans(run(few))


def test_questions_share_their_scans(spark, ix):
    from textlode.plans import questions
    scans = lambda df: plan_of(df).count("Scan ")
    texts = ["heap insert", "helper", "how is baz built", "Foo bar", "counter limit tuple page"]
    one, many = (questions.search_questions(ix, questions.asked(spark, q)) for q in (texts[:1], texts))
    assert scans(one[0]) == scans(many[0]) and scans(one[1]) == scans(many[1])
    alone = {(r.key, r.match_score, r.match_source) for r in one[0].collect()}
    assert alone and alone == {(r.key, r.match_score, r.match_source) for r in many[0].filter("question = 0").collect()}


def test_positional_postings_find_what_a_scan_finds(spark):
    rng = __import__("random").Random(4)
    rows = [(f"f{i}", "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 2, 30, 200]))), "c", i) for i in range(80)]
    files = spark.createDataFrame(rows, "path string, content string, language string, ord long").cache()
    posts = index.positioned_trigrams(files)
    for wanted in ("aba", "ab ba", "a   b", "AAb", "ab\na"):
        scan = {(r.path, r.match_count, str(r.matches)) for r in rank.trigram_file_search(files, wanted).collect()}
        assert scan == {(r.path, r.match_count, str(r.matches)) for r in rank.trigram_file_search(files, wanted, posts=posts).collect()}
        lines = rank.lines_by_postings(files, posts, wanted).collect()
        assert {tuple(r) for r in rank.find_text_in_code(grep.corpus_lines(files), wanted).collect()} == {tuple(r) for r in lines}
    terms = spark.createDataFrame([("aba",), ("b a",)], "term string")
    got = {(r.term, r.path): sorted(r.offsets) for r in rank.literal_offsets(posts, terms).collect()}
    assert got == {(t, p): at for t in ("aba", "b a") for p, c, _, _ in rows if (at := [i for i in range(len(c)) if c.startswith(t, i)])}
