"""Words that are counted inside a document's row: the same counts, without a shuffle of words."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from textlode import catalog
from textlode.functions import text
from textlode.operators import index, ordering, segments, vocabulary

SF = "/root/testdata/sf0.001"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()[out.getvalue().index("== Physical"):]


def _files(spark):
    body = "Parsing parsed carried carrying indexes aa a the The HTTPServer heapInsert x9 // some note\n'quoted word' \"more words\" /* block */ parsing carry"
    rows = [(f"src/dir{i % 2}/f{i}.txt", f"{body} alpha{i} {'again ' * (400 * i)}", "txt", i) for i in range(6)]
    rows += [("none.txt", None, "txt", 30), ("src/empty.txt", "", "txt", 31), ("odd.txt", f"{'x' * 50} {'y' * 51} {'z' * 40} {'w' * 41} Kelvin Bİz b", "txt", 32)]
    return spark.createDataFrame(rows, "path string, content string, language string, ord long").repartition(2)


def test_runs_are_the_words_between_other_characters(spark):
    s = " ".join(n * "q" for n in (1, 2, 3, 29, 30, 40, 41, 50, 51, 101)) + " a_b __ é9é q1"
    got = spark.range(1).select(*[f(F.lit(s)).alias(n) for n, f in (("i", text.index_tokens), ("v", text.vector_tokens), ("l", text.learner_tokens))]).first()
    for words, letters, most in ((got.i, "a-z0-9", 50), (got.v, "a-z0-9_", 29), (got.l, "a-z0-9", 40)):
        least = 3 if words is got.v else 2
        assert words == re.findall(f"(?<![{letters}])[{letters}]{{{least},{most}}}(?![{letters}])", s)


def test_posting_lists_are_the_postings(spark):
    docs = index.plain_feed(_files(spark))
    lists = index.posting_lists(docs)
    rows = lists.select("doc_id", "doc_type", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf", "freq")))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, index.postings(docs).collect()))
    assert "hashpartitioning" not in _plan(lists)


def test_stop_words_shuffle_no_words_of_files(spark):
    files = _files(spark)
    want = sorted(map(tuple, vocabulary.learned_stop_words(vocabulary.document_terms(vocabulary.weighted_terms(files))).collect()))
    assert sorted(map(tuple, vocabulary.stop_words_of(files).collect())) == want
    twice = files.unionByName(files.filter("ord = 1"))  # a path of two rows is one file
    assert not ordering.one_row_each(twice, "path") and ordering.one_row_each(files, "path")
    assert sorted(map(tuple, vocabulary.stop_words_of(twice).collect())) == want


def test_posting_records_are_one_of_each_document(spark):
    assert "hashpartitioning" not in _plan(catalog.load()["snk_04_posting_records"][0](spark, SF))


def test_lists_count_as_rows_do(spark):
    files = _files(spark)
    for got, value, want in ((index.term_lists(files, ("path",)), "tf", index.term_frequencies(files, ("path",))),
                             (vocabulary.weight_lists(files), "weights", vocabulary.document_terms(vocabulary.weighted_terms(files)))):
        assert sorted(map(tuple, segments._entries(got, value, "n").collect())) == sorted(map(tuple, want.collect()))
        assert "hashpartitioning" not in _plan(got)


def test_parts_of_names_are_split_before_their_capitals(spark):
    s = "aB fooBarBAZ HTTPServer parseHTTPRequestX9y XMLHttp aBC ABc aBCd ABCDe x9Yz ÉAb éB A1Bc"
    got = spark.range(1).select(text.split_camel(F.lit(s)).alias("c"), text.learner_tokens(F.lit(s)).alias("l")).first()
    camel = re.sub("([a-z])([A-Z])", r"\1 \2", s)
    assert got.c == camel
    assert got.l == [w for w in re.findall("[a-z0-9]+", re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", camel).lower()) if len(w) > 1]


def test_segments_of_repeated_paths_are_grouped(spark, tmp_path):
    files = _files(spark)
    ix = segments.create(files, str(tmp_path / "a"))
    cols = ["doc_id", "doc_type", "term", "tf", "freq"]
    assert sorted(map(tuple, ix.postings().select(*cols).collect())) == sorted(map(tuple, index.postings(index.plain_feed(files)).select(*cols).collect()))
    twice = segments.create(files.unionByName(files.filter("ord = 1")), str(tmp_path / "b"))
    assert {r.term: r.df for r in twice.frequencies().collect()}["alpha1"] == 1


def test_vectors_of_a_large_vocabulary_send_frequent_terms_alone(spark, monkeypatch):
    rows = [(f"f{i}", f"usual {'often ' * (i % 2)}third{i % 3} fifth{i % 5} fifth{i % 5} ninth{i % 9} only{i}", i) for i in range(40)]
    files = spark.createDataFrame([*rows, ("none", None, 40)], "path string, content string, ord long").repartition(3)
    vocab = index.vocabulary(files, "path", "content")
    rows = lambda: {(r.path, r.bucket): round(r.weight, 9) for r in index.tfidf_sparse(files, vocab, "path", "content").collect()}
    whole, n = rows(), vocab.count()
    assert whole
    for most in (n - 1, 3, 1):
        monkeypatch.setattr(index, "BROADCAST_TERMS", most)
        assert rows() == whole


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    files = _files(spark)
    vocab = spark.createDataFrame([("again", 0, 3, 0.5)], "term string, idx long, df long, idf double")
    monkeypatch.setattr(index, "TASK_CHARS", 1000)
    size = files.agg(F.sum(F.length("content"))).first()[0]
    assert "REPARTITION_BY_NUM" in _plan(index.tfidf_sparse(files, vocab, "path", "content"))
    assert f", {-(-size // 1000)})" in _plan(index.tfidf_sparse(files, vocab, "path", "content"))


def test_nearest_to_the_first_vector_makes_vectors_of_all_texts_once(spark):
    plan = _plan(catalog.load()["rnk_04_tfidf_vector_search"][0](spark, SF))
    assert "Subquery" not in plan
