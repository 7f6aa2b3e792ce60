"""Segments against a rebuild, packing and co-occurrence against plain loops, sources and command logs on small rows."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textlode.operators import context, index, segments, session, topk, vocabulary


def state(ix):
    posts = sorted(map(tuple, ix.postings().select("doc_id", "term", "tf").collect()))
    weights = sorted((r.term, r.df, round(r.weight, 9)) for r in ix.learned().collect())
    return posts, sorted(map(tuple, ix.frequencies().collect())), weights, ix.n_docs, ix.n_files


def test_segments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "index", "build", "heap", "page"]
    files = {f"f{i}.py": " ".join(rng.choice(words) for _ in range(rng.choice([1, 8, 30]))) for i in range(24)}
    table = lambda d: spark.createDataFrame([(p, c, "python", i) for i, (p, c) in enumerate(d.items())], "path string, content string, language string, ord long")
    some = lambda lo, hi: dict(list(files.items())[lo:hi])
    changed = {p: c + " changed" for p, c in some(3, 6).items()}
    ix = segments.create(table(some(0, 10)), str(tmp_path / "a"))
    ix = segments.add(ix, table(some(10, 20) | changed))
    ix = segments.remove(ix, spark.createDataFrame([("f1.py",), ("f12.py",), ("missing",)], "path string"))
    ix = segments.add(ix, table(some(20, 24)))
    now = {p: c for p, c in (files | changed).items() if p not in ("f1.py", "f12.py")}
    rebuilt = segments.create(table(now), str(tmp_path / "b"))
    assert state(ix) == state(rebuilt)
    untouched = ix.segments[-1]
    small = segments.compact(ix, segments.smallest(ix, 3)[:2])
    assert state(small) == state(rebuilt) and len(small.segments) == len(ix.segments) - 1
    one = segments.compact(small)
    assert state(one) == state(rebuilt) and len(one.segments) == 1 and one.deletes() is None and untouched not in one.segments
    assert segments.current(spark, ix.root) == one
    gone = segments.remove(one, table(files).select("path"))
    assert gone.n_docs == 0 and gone.postings().count() == 0 and gone.frequencies().count() == 0
    read = ix.postings(terms=["heap"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,heap)]" in read


@pytest.mark.parametrize("listed", [1, 4, 10_000])
def test_joint_counts_by_bitmaps_and_by_lists(spark, listed):
    rng = random.Random(listed)
    docs = {f"t{t}": {d for d in range(300) if rng.random() < rng.choice([0.01, 0.3])} for t in range(12)}
    rows = spark.createDataFrame([(t, f"d{d}") for t, ds in docs.items() for d in ds], "term string, path string")
    pairs = spark.createDataFrame([(a, b, len(docs[a]), len(docs[b])) for a, b in combinations(sorted(docs), 2)], "t1 string, t2 string, d1 long, d2 long")
    got = {(r.t1, r.t2): r.joint for r in vocabulary.joint_counts(pairs, rows, listed).collect()}
    assert got == {(a, b): n for a, b in combinations(sorted(docs), 2) if (n := len(docs[a] & docs[b]))}


@pytest.mark.parametrize("budget", [1, 7, 40, 1000])
def test_packing_takes_each_item_that_still_fits(spark, budget):
    rng = random.Random(budget)
    sizes = [rng.choice([0, 1, 2, 5, 9, 30, 100]) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(3)
    want, used = [], 0
    for i, n in enumerate(sizes):
        if used + n < budget:
            want.append(i)
            used += n
    assert sorted(r.id for r in topk.pack(items, budget, ("id",)).collect()) == want
    assert topk.pack(items.limit(0), budget, ("id",)).count() == 0


def test_command_log_changes_what_later_commands_see(spark):
    turns = spark.createDataFrame([("s", 10, "q1", "a1"), ("s", 20, "q2", "a2"), ("s", 60, "q3", "a3")], "session string, seq int, user string, assistant string")
    log = [(5, "/bookmark 1"), (11, "/bookmark 1"), (12, "/bookmark 2"), (21, "/tag 2 x"), (22, "/tag 2 x"), (23, "/tagged x"), (24, "/bookmarks"), (25, "/export-session"), (30, "plain text"),
           (50, "/clear-history"), (55, "/show 1"), (65, "/show 1"), (66, "/bookmarks"), (67, "/stats"), (68, "/tagged x")]
    got = session.replay_commands(spark.createDataFrame([("s", n, c) for n, c in log], "session string, seq int, command string"), turns)
    rows = {(r.seq, r.number, r.part): r.text for r in got.collect()}
    assert rows[5, 1, "changed"] == "false" and rows[11, 1, "changed"] == "true" and rows[12, 2, "changed"] == "false"
    assert (23, 2, "summary") in rows and (24, 1, "summary") in rows and (24, 2, "summary") not in rows
    assert rows[25, None, "state"] == '{"turns":2,"bookmarks":[1],"tags":[{"tag":"x","number":2}]}'
    assert not [k for k in rows if k[0] in (30, 55, 66, 68)] and rows[65, 1, "user"] == "q3" and rows[67, None, "totals"] == "1|4|0|0|0"


def test_sources_of_a_request(spark):
    long = "x" * 60
    parts = spark.createDataFrame([(1, "piped", 0, "p", long), (1, "history", 0, "h", long), (2, "history", 0, "h", "short"), (2, "workspace", 1, "b", "B"), (2, "workspace", 0, "a", "A"),
                                   (3, "attachments", 0, "f", "tiny")], "request int, source string, ord int, name string, content string")
    requests = spark.createDataFrame([(1, True, False, False, True), (2, True, True, False, False), (3, False, False, True, False), (4, True, True, True, False)],
                                     "request int, h boolean, w boolean, a boolean, llm boolean")
    got = {r.request: (list(r.sources_used), r.content) for r in context.gather_sources(parts, requests).collect()}
    assert got[1] == (["🔗 Piped", "🤖 LLM only"], long + "\n\n") and got[3] == ([], "") and got[4] == ([], "")
    assert got[2] == (["🔍 Workspace (2 files)"], "short\n\n## Reference Code from Workspace\n\nAB\n\n")


def test_postings_of_segments_read_as_index_postings(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "heap index heap", "python", 1)], "path string, content string, language string, ord long")
    ix = segments.create(files, str(tmp_path / "x"))
    plain = index.postings(index.plain_feed(files)).select("doc_id", "doc_type", "term", "tf", "freq")
    assert sorted(map(tuple, ix.postings().collect())) == sorted(map(tuple, plain.collect()))
    assert ix.documents().select(F.col("path")).first()["path"] == "a.py"
