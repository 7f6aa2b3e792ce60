"""Work that is done once: a question's actions, the patterns of COBOL files, the words of a completion."""

import contextlib
import io

from pyspark.sql import functions as F

from textlode.functions import text
from textlode.operators import cobol, index, vocabulary


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()[out.getvalue().index("== Optimized"):]


def test_actions_are_found_outside_the_terms(spark):
    rows = [("how is the index built and scanned", ["indexes", "scann", "to"]), ("nothing", ["heap"]), (None, ["heap"]), ("made", None)]
    df = spark.createDataFrame(rows, "q string, t array<string>")
    made = df.select(text.compound_terms(F.col("q"), F.col("t")).alias("c"))
    assert [r.c for r in made.collect()] == [["index_built", "built_index", "index_scann", "scann_index", "scann_built", "built_scann"], [], [], None]
    plan = _plan(made.select(F.size("c")))
    assert "transform(array(filter(transform(" in plan  # bound before the terms are looped over


def test_cobol_tables_search_files_once(spark):
    program = "       05 AREA OCCURS 5 TIMES INDEXED BY IX.\n           EXEC SQL SELECT A FROM T1 END-EXEC.\n           EXEC SQL UPDATE T1 SET A = 1 END-EXEC.\n       FD  F1.\n       FD  F1.\n"
    files = spark.createDataFrame([("a.cbl", program, "cobol", 1), ("a.cbl", program, "cobol", 2), ("b.cbl", None, "cobol", 3)], "path string, content string, language string, ord long")
    found = cobol.all_tables(cobol.inventory(files))
    assert sorted(tuple(r) for r in found.collect()) == sorted([("a.cbl", "cobol", "AREA", 1)] * 2 + [("a.cbl", "sql", "T1", 2)] + [("a.cbl", "file", "F1", n) for n in (4, 5)] * 2)
    plan = _plan(cobol.table_counts(found))
    assert plan[plan.index("== Physical"):].count("Generate posexplode") == 2  # of one search: rules, then matches


def test_terms_of_a_prefix_are_those_of_the_whole_table(spark):
    rows = [(f"src/an{i}.txt", f"And any tables{i % 3} carried ANswers carries antenna a an AnyThing Kan Kan // annotated\n'and more'", "txt", i) for i in range(9)]
    files = spark.createDataFrame([*rows, ("none.txt", None, "txt", 30)], "path string, content string, language string, ord long")
    whole = {tuple(r) for r in index.term_frequencies(files, ("path",)).collect()}
    learned = sorted(tuple(r) for r in vocabulary.weighted_terms(files).collect())
    for prefix in ("an", "carr", "carry", "x", "é", "a"):
        assert {tuple(r) for r in index.term_frequencies(files, ("path",), prefix=prefix).collect()} == {r for r in whole if r[1].startswith(prefix)}
        assert sorted(tuple(r) for r in vocabulary.weighted_terms(files, prefix).collect()) == [r for r in learned if r[2].startswith(prefix)]
    assert {r[1] for r in whole} >= {"antenna", "carry", "answer"}


def test_grams_of_a_text_are_cut_once_and_not_compared_one_by_one(spark):
    rows = [("a", "abcabcab 7\n1é1é1é1", 1), ("b", "ab", 2), ("c", None, 3), ("d", "   \U0001f600x", 4), ("e", "10000000001000000000", 5)]
    df = spark.createDataFrame(rows, "path string, content string, ord long")
    want = {}
    for path, t, _ in rows[:2] + rows[4:]:
        for i in range(len(t) - 2):
            want.setdefault((path, t[i:i + 3]), []).append(i)
    posts = index.positioned_trigrams(df)
    assert {(r.path, r.tri): r.positions for r in posts.filter("path <> 'd'").collect()} == want
    plan = _plan(posts)
    plan = plan[:plan.index("== Physical")]
    assert plan.count("(?s)(?=(...))") == plan.count("lambdafunction(") == 1
