from pyspark.sql import functions as F

from textlode.operators import grep


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}.c", t, "c", i) for i, t in enumerate(contents)], "path string, content string, language string, ord long")


def hits(df):
    return sorted((r["path"], r["line"], r["column"]) for r in df.collect())


def test_overlapping_and_case(spark):
    df = files(spark, "aaaa\n", "\nAa aA")
    assert hits(grep.search_literal(df, "aa")) == [("f0.c", 1, 1), ("f0.c", 1, 2), ("f0.c", 1, 3), ("f1.c", 2, 1), ("f1.c", 2, 4)]
    assert hits(grep.search_literal(df, "Aa", case_sensitive=True)) == [("f1.c", 2, 1)]


def test_brute_force(spark):
    text = "abab\nbaba ab.b\n\nab"
    df = files(spark, text)
    for p in ("ab", "b", "ba ", ".b", "b\nb", "\n\na"):
        want = []
        at = text.find(p)
        while at >= 0:
            want.append(("f0.c", text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)))
            at = text.find(p, at + 1)
        assert hits(grep.search_literal(df, p)) == sorted(want), p


def test_whole_word_context_and_cap(spark):
    df = files(spark, "one\ntwo cat\ncats\n_cat\n(cat)\nend")
    got = grep.search_literal(df, "cat", whole_word=True).orderBy("line").collect()
    assert [(r["line"], r["column"]) for r in got] == [(2, 5), (5, 2)]
    assert got[0]["before"] == ["one"] and got[0]["after"] == ["cats", "_cat"]
    assert grep.search_literal(df, "cat", max_results=2).count() == 2


def test_regex_spans_lines_and_errors(spark):
    df = files(spark, "foo(\n  a)\nbar(a)")
    got = grep.search_regex(df, r"(\w+)\(\s*a\)", groups=1).orderBy("line").collect()
    assert [(r["line"], r["column"], r["groups"]) for r in got] == [(1, 1, ["foo"]), (3, 1, ["bar"])]
    bad = grep.search_regex(df, "(")
    assert "Invalid regex" in bad.first()["match_text"] and bad.columns == grep.search_regex(df, "a").columns and bad.count() == 1


def test_call_sites_stored_twice_for_members(spark):
    df = files(spark, "f(x); o.f(x); p->f(x);\nreturn g(x);\nif (x) C::h(1)")
    n = {r["fn"]: r["n"] for r in grep.call_sites(df).groupBy("fn").agg(F.count("*").alias("n")).collect()}
    assert n == {}  # one-letter names are dropped
    df = files(spark, "ff(x); o.ff(x); p->ff(x);\nreturn gg(x);\nint ff(int a)\nC::hh(1); if (x)")
    rows = [(r["fn"], r["rule"], r["line"], r["column"]) for r in grep.call_sites(df).orderBy("rule", "match_no").collect()]
    assert rows == [("ff", 0, 1, 1), ("ff", 0, 1, 10), ("ff", 0, 1, 20), ("gg", 0, 2, 8), ("ff", 0, 3, 5), ("hh", 0, 4, 4),
                    ("ff", 1, 1, 9), ("ff", 2, 1, 18), ("hh", 3, 4, 2)]
    assert grep.search_calls(df, "gg").count() == 0  # "return gg(" reads like a definition
    assert {r["line"] for r in grep.search_calls(df, "ff").collect()} == {1}


def test_call_sites_of_statements_without_a_bracket(spark):
    df = spark.createDataFrame([("a.tal", "BEGIN CALL go_on;\nCALL other(x);", "tal", 1), ("b.cbl", "PERFORM MAIN-1.\nPERFORM UNTIL X", "cobol", 2), ("c.c", "CALL go_on; f2(x)", "c", 3)],
                               "path string, content string, language string, ord long")
    rows = [(r["path"], r["fn"], r["line"]) for r in grep.call_sites(df).orderBy("ord", "line").collect()]
    assert rows == [("a.tal", "go_on", 1), ("a.tal", "other", 2), ("b.cbl", "MAIN-1", 1), ("c.c", "f2", 1)]


def test_usages_prefer_calls(spark):
    df = files(spark, "x = ff;\nff(1);\nff(2); ff")
    got = {(r["line"], r["usage_type"]) for r in grep.symbol_usages(df, "ff").collect()}
    assert got == {(1, "reference"), (2, "call"), (3, "call")}


def test_enclosing_function(spark, code):
    got = {(r["line"], r["enclosing_name"]) for r in grep.search_with_function(code, "helper").collect()}
    assert got == {(6, "heap_insert"), (10, "helper"), (13, "helper")}


def test_nothing_is_cut_by_default(spark):
    """A file of over 500 000 characters, a line of over 500, more than 200 hits."""
    from textlode.operators import index, rank
    big = "word " * 120_000 + "\nneedle " + "x" * 600 + " needle\n" + "hit\n" * 300
    df = spark.createDataFrame([("big.c", big, "c", 1)], "path string, content string, language string, ord int")
    assert grep.search_literal(df, "needle").count() == 2 and grep.search_literal(df, "hit").count() == 300
    assert grep.search_regex(df, "needle").count() == 2
    assert rank.find_text_in_code(grep.corpus_lines(df), "needle").count() == 1
    assert rank.trigram_file_search(df, "hit").first()["match_count"] == 300
    assert index.line_trigrams(grep.corpus_lines(df)).filter("tri = 'xxx'").count() == 1
    assert index.positioned_trigrams(df).filter("tri = 'wor'").first()["positions"][-1] == 5 * 119_999


def test_cooccurrence_reads_long_documents(spark):
    from itertools import combinations
    from textlode.operators import vocabulary
    docs = {f"d{d}": {f"t{(d * 131 + i * 7) % 997}" for i in range(20 + 60 * d)} for d in range(12)}
    assert max(map(len, docs.values())) > 500
    table = spark.createDataFrame([(p, t) for p, ts in docs.items() for t in ts], "path string, term string")
    at = {}
    for p, ts in docs.items():
        for t in ts:
            at.setdefault(t, set()).add(p)
    usable = {t: ps for t, ps in at.items() if 2 <= len(ps) <= 6}
    want = {}
    for x, y in combinations(sorted(usable), 2):
        both, either = len(usable[x] & usable[y]), len(usable[x] | usable[y])
        if both >= 2 and both / either >= 0.3:
            want[x, y] = both
    got = {(r.t1, r.t2): r.joint for r in vocabulary.synonyms(table).collect()}
    assert got == want and want


def test_regex_groups_and_widths(spark):
    df = spark.createDataFrame([("a.c", "aabb\nxx yy\nabc(1,2,3,4)", 1)], "path string, content string, ord int")
    assert [(r["line"], r["column"]) for r in grep.search_regex(df, r"(\w)\1").orderBy("line", "column").collect()] == [(1, 1), (1, 3), (2, 1), (2, 4)]
    assert [r["line"] for r in grep.search_regex(df, "^").orderBy("line").collect()] == [1, 2, 3]
    assert grep.search_regex(df, r"(\w)\((\d),(\d),(\d),(\d)\)", groups=5).first()["groups"] == ["c", "1", "2", "3", "4"]
    assert grep.search_regex(df, "(?<n>aa)").count() == 1
