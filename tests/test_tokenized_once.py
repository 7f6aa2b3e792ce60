"""Plans in which a text is cut into words once and a document's rows are dealt once."""

import contextlib
import io
import itertools

from pyspark.sql import functions as F

from textlode.functions import text
from textlode.operators import index, joins


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()[out.getvalue().index("== Optimized"):]


def _files(spark):
    rows = [(f"src/f{i}.txt", f"Parsing tables{i % 3} carried indexes hear heard alpha{i} beta", "txt", i) for i in range(30)]
    return spark.createDataFrame([*rows, ("none.txt", None, "txt", 30), ("empty.txt", "", "txt", 31)], "path string, content string, language string, ord long").repartition(2)


def test_no_filter_makes_words_again(spark):
    files = _files(spark)
    for df in (index.term_frequencies(files, ("path",)), index.document_frequencies(files, "path", "content")):
        assert "(size(" not in _plan(df)


def test_wanted_terms_are_those_of_the_whole_table(spark):
    files = _files(spark)
    whole = {tuple(r) for r in index.term_frequencies(files, ("path",)).collect()}
    for only in (["pars", "carry"], ["tables1", "hear"], ["index", "beta"], ["x"]):
        assert {tuple(r) for r in index.term_frequencies(files, ("path",), only=only).collect()} == {r for r in whole if r[1] in only}
    assert {r[1] for r in whole} >= {"pars", "carry", "index", "hear", "tables1"}


def test_vectors_of_a_document_move_once(spark):
    files = _files(spark)
    vocab = spark.createDataFrame([("beta", 0, 30, 0.5)], "term string, idx long, df long, idf double")
    plan = _plan(index.tfidf_sparse(files, vocab, "path", "content"))
    assert plan[plan.index("== Physical"):].count("Exchange hashpartitioning") == 1


def test_symbols_near_merge_past_the_hits(spark):
    hits = spark.createDataFrame([("a.c", 10), ("a.c", 100)], "path string, line int")
    symbols = spark.createDataFrame([("k1", "a.c", 55), ("k2", "a.c", 61), ("k3", "b.c", 10)], "key string, file string, line int")
    near = joins.symbols_near(hits, symbols)
    assert sorted((r.line, r.symbol.key) for r in near.collect()) == [(10, "k1"), (100, "k1"), (100, "k2")]
    assert "SortMergeJoin" in _plan(near)


def test_only_words_of_wanted_stems_are_cut_out(spark):
    ends = ("", "s", "es", "ed", "ied", "ies", "ing", "ting", "y", "x", "ingly")
    words = [a + b for a, b in itertools.product(("par", "carr", "stop", "t", "sto", "ind\u212aex", "B\u0130z", "x" * 48), ends)]
    files = spark.createDataFrame([(" ".join(words), 1), (None, 2), ("", 3)], "content string, ord long")
    rows = files.select("ord", F.explode(text.index_tokens(F.col("content"))).alias("w")).select("w", text.stem(F.col("w")).alias("t")).collect()
    assert "ind" in {r.w for r in rows} and "indkex" not in {r.w for r in rows}  # only ASCII letters are lowered into words
    for stems in (["par"], ["carry", "sto"], ["stop", "ts"], ["x" * 48, "x" * 60], ["é", "a b", "b"]):
        some = files.select(F.explode(text.index_tokens(F.col("content"), stems)).alias("w")).select("w", text.stem(F.col("w")).alias("t")).collect()
        assert [r for r in some if r.t in stems] == [r[:2] for r in rows if len(r.t) > 1 and r.t in stems]
        assert len(some) < len(rows) / 2


def test_posting_scores_cut_texts_once(spark):
    from textlode import catalog
    df = catalog.load()["rnk_02_posting_scores"][0](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
