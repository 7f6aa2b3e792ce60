import pytest
from pyspark.sql import functions as F

from textlode.functions import classify, markup, paths, text
from textlode.operators import rank


def ev(spark, expr):
    return text.evaluate(spark, expr)


@pytest.mark.parametrize("word, want", [("running", "run"), ("stopped", "stop"), ("tried", "try"), ("classes", "class"), ("boxes", "box"),
                                        ("indexes", "index"), ("glass", "glass"), ("bus", "bus"), ("ing", "ing"), ("red", "red"), ("bring", "bring")])
def test_stem(spark, word, want):
    assert ev(spark, text.stem(F.lit(word))) == want


def py_hash(s):
    h = 5381
    for ch in s:
        h = (h * 33 + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


@pytest.mark.parametrize("s", ["", "a", "heap_insert_tuple_long", "é"])
def test_djb2(spark, s):
    assert ev(spark, text.djb2(F.lit(s))) == py_hash(s)


def test_fuzzy_tiers(spark):
    f = lambda q, t: ev(spark, text.fuzzy_score(F.lit(q), F.lit(t)))
    assert f("heap", "HEAP") == 100 and f("heap", "heap_x") == 95 and f("heap", "my_heap") == 90 and f("eap", "heapx") == 85
    assert f("rte", "RangeTblEntry") == 80 and round(f("hin", "heap_insert"), 3) == 65.455 and f("heal", "heap") == 37.5 and f("zzz", "heap") == 0


def test_search_terms(spark):
    got = ev(spark, text.search_terms(F.lit("How are Indexes_built queries?")))
    assert got == ["how", "are", "indexes_built", "queries", "query", "indexes", "built"]
    assert ev(spark, text.compound_terms(F.lit("how are indexes built"), F.array(F.lit("indexes")))) == ["index_built", "built_index"]


def test_query_parsing(spark):
    i = ev(spark, classify.intent(F.lit("who calls heap_insert")))
    assert (i["intent"], i["target"]) == ("callers", "heap_insert")
    assert ev(spark, classify.sub_questions(F.lit("1. what is a\n2) how is b"))) == ["what is a", "how is b"]
    m = ev(spark, classify.modifiers(F.lit("/source llm /in a,-b /spec x rest of it")))
    assert (m["model_only"], m["history"], m["include"], m["exclude"], m["spec"], m["query"]) == (True, False, ["a"], ["b"], "x", "rest of it")


def test_fenced_blocks(spark):
    got = ev(spark, text.fenced_blocks(F.lit("a```py\nx=1\n``` b ```\nzz```")))
    assert [tuple(b) for b in got] == [("py", "x=1", 1, 14), ("text", "zz", 17, 26)]


def test_markup_round(spark):
    assert ev(spark, markup.to_markdown(F.lit("<h2 a>T</h2><ul><li>x</li></ul><a href=\"u\">l</a>&amp;"))) == "## T\n\n- x\n\n[l](u)&"
    assert ev(spark, markup.to_wiki(F.lit("## T\n|a|b|\n```py\nx\n```"))) .startswith("<h2>T</h2>\n<table><tbody><tr><td>a</td><td>b</td></tr>")


def test_paths(spark):
    assert ev(spark, paths.extension(F.lit("a/.env"))) == "" and ev(spark, paths.base_name(F.lit("a/b.tar.gz"))) == "b.tar"
    assert ev(spark, paths.suffixes(F.lit("/a/b/c.x"))) == ["/a/b/c.x", "c.x", "b/c.x", "a/b/c.x"]
    assert ev(spark, paths.human_size(F.lit(1280))) == "1.3 KB"


def test_cosine_properties(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert ev(spark, rank.cosine(v(1, 2), v(2, 4))) == pytest.approx(1.0)
    assert ev(spark, rank.cosine(v(1, 2), v(1,))) == 0 and ev(spark, rank.cosine(v(0, 0), v(1, 1))) == 0


def test_split_at_lines_keeps_text(spark):
    t = "aaa\nbb\ncccccccc\nd"
    parts = ev(spark, text.split_at_lines(F.split(F.lit(t), "\n"), 8))
    assert "".join(parts) == t + "\n" and parts == ["aaa\nbb\n", "cccccccc\n", "d\n"]
