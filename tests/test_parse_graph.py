import random
import re

from pyspark.sql import functions as F

from textlode.operators import graph, ordering, parse


def test_symbols(spark, code):
    got = {(r["name"], r["type"], r["line"]) for r in parse.parse_symbols(code).filter("file <> 'notes.md'").collect()}
    # the blank line in front of helper belongs to its match
    assert got == {("heap_insert", "function", 5), ("helper", "function", 9), ("Foo", "struct", 15), ("MAX", "macro-function", 2),
                   ("counter", "variable", 3), ("Foo", "class", 2), ("bar", "method", 3), ("baz", "method", 6), ("LIMIT", "constant", 8)}


def test_summaries(spark, code):
    got = {r["name"]: r["summary"] for r in parse.parse_symbols(code).collect()}
    assert got["heap_insert"] == "Insert a tuple into the heap page" and got["baz"] == "Computes the base value" and got["helper"] == "Helper"


def test_bodies_and_calls(spark, code):
    st = parse.symbol_table(parse.parse_symbols(code, with_summary=False))
    ends = {r["name"]: (r["line"], r["end_line"]) for r in parse.body_ends(st, code).collect()}
    assert ends["heap_insert"] == (5, 9) and ends["helper"] == (9, 15) and ends["bar"] == (3, 5)
    calls = {r["caller"]: set(r["calls"]) for r in parse.call_lists(st, code).collect()}
    assert calls == {"heap_insert": {"helper", "put", "other_fn"}, "helper": {"heap_insert"}, "bar": {"baz"}}


def test_duplicate_names_last_definition_wins(spark):
    rows = [("a.c", "int hh(int a) {\n  one(a);\n}\n", "c", 1), ("b.c", "int hh(int a) {\n  two(a);\n  hh(a);\n}\n", "c", 2)]
    files = spark.createDataFrame(rows, "path string, content string, language string, ord long")
    lists = ordering.cut_lineage(parse.call_lists(parse.symbol_table(parse.parse_symbols(files, with_summary=False)), files))
    ref = {(r["caller"], r["callee"]) for r in parse.call_edges(lists, "reference").collect()}
    both = {(r["caller"], r["callee"]) for r in parse.call_edges(lists).collect()}
    assert ref == {("hh", "two")} and both == {("hh", "one"), ("hh", "two")}


PIECES = {
    "c": ["int f{}(int a) {{", "}}", "{{", "x = 1;", "call{}(1);", "if (a) {{ b(); }}", "}} else {{", "", "int p{}(int);", "{{ }} {{"],
    "python": ["def f{}(a):", "    def g{}(b):", "    x{}(1)", "", "  y = 2", "class K{}:", "        return h{}(2)", "# c"],
    "sql": ["CREATE FUNCTION f{}(a INT) AS", "BEGIN", "END;", "  q{}(1)", "BEGIN x END", ""],
    "cobol": ["       PARA-{}.", "           PERFORM X{}.", "           END-IF.", "       SEC{} SECTION.", ""],
    "tal": ["PROC p{};", "BEGIN", "CALL c{};", "END;", "SUBPROC s{};"]}


def plain_end(lines, at, language):
    """Last line of the body that starts on line ``at``, walked from there."""
    n = len(lines)
    if language == "python":
        lead = lambda t: len(t) - len(t.lstrip())
        found = [i for i in range(at + 1, n + 1) if lines[i - 1].strip() and lead(lines[i - 1]) <= lead(lines[at - 1])]
        return min(found[0] if found else n, n)
    if language == "cobol":
        for i in range(at + 1, n + 1):
            if re.search(r"(?i)^.{7}[A-Z0-9][-A-Z0-9]*\s*(SECTION)?\s*\.\s*$", lines[i - 1]):
                return i
            if re.search(r"(?i)^\s*END-", lines[i - 1][7:]):
                return min(i + 1, n)
        return n
    depth = 0
    for i in range(at, n + 1):
        t = lines[i - 1]
        marks = re.findall("[{}]", t) if language == "c" else ["{"] * ("BEGIN" in t) + ["}"] * ("END" in t)
        closed = False
        for m in marks:
            depth += 1 if m == "{" else -1
            closed |= m == "}" and depth == 0
        if closed:
            return min(i + 1, n)
    return min(at + 200, n)


def test_body_ends_of_nested_unclosed_and_repeated_definitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        language = rng.choice(list(PIECES))
        content = "\n".join(rng.choice(PIECES[language]).format(*[rng.randrange(9)] * 3) for _ in range(rng.choice([0, 1, 5, 40, 400])))
        rows.append((f"d{i}.x", content, language, i))
    files = spark.createDataFrame(rows, "path string, content string, language string, ord long")
    table = ordering.cut_lineage(parse.symbol_table(parse.parse_symbols(files, with_summary=False)))
    texts = {p: (c.split("\n"), language) for p, c, language, _ in rows}
    got = parse.body_ends(table, files).collect()
    assert len(got) > 150 and all(r.end_line == plain_end(texts[r.path][0], r.line, texts[r.path][1]) for r in got)
    odd = table.withColumn("line", F.when(F.col("ord") == table.agg(F.max("ord")).scalar(), 9999).otherwise(F.col("line")))
    assert parse.body_ends(odd, files).count() == len(got)


def test_call_graph_reads_files_once_in_three_exchanges(spark, code):
    table = ordering.cut_lineage(parse.symbol_table(parse.parse_symbols(code, with_summary=False)))
    stored = ordering.cut_lineage(code)
    edges = parse.call_edges(parse.call_lists(table, stored))
    edges.count()
    plan = edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    edges.explain("formatted")
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Scan ExistingRDD") == 2


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("e", "a"), ("c", "leaf")]


def edge_table(spark):
    return spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(EDGES)], "caller string, callee string, ord long")


def brute_paths(s, t, depth):
    out = []

    def walk(path):
        if path[-1] == t:
            out.append(tuple(path))
            return
        if len(path) <= depth:
            for x, y in EDGES:
                if x == path[-1] and y not in path:
                    walk(path + [y])
    walk([s])
    return sorted(out)


def test_paths_match_brute_force(spark):
    e = edge_table(spark)
    for s, t, d in (("a", "c", 10), ("e", "leaf", 10), ("e", "leaf", 3), ("b", "d", 2)):
        got = sorted(tuple(r["path"]) for r in graph.call_paths(e, s, t, d).collect()) if brute_paths(s, t, d) else []
        assert got == brute_paths(s, t, d)


def test_neighbourhood_reaches_edges_out_of_last_depth(spark):
    got = {(r["caller"], r["callee"]) for r in graph.neighbourhood(edge_table(spark), "e", 1).collect()}
    assert got == {("e", "a"), ("a", "b"), ("a", "d")}


def test_entry_leaf_stats(spark):
    e = edge_table(spark)
    defs = spark.createDataFrame([(n, "f.c", 1, "function") for n in ("a", "e", "leaf")], "name string, file string, line int, type string")
    assert [r["name"] for r in graph.entry_points(e, defs).collect()] == ["e"]
    assert [r["name"] for r in graph.leaf_functions(e, defs).collect()] == ["leaf"]
    s = graph.degree_stats(e).first()
    assert (s["functions"], s["edges"], s["max_in_degree"]) == (5, 7, 2)


def test_number_rows_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), "id")
    got = ordering.number_rows(df, "k", ["k"], "n", buckets=16)
    assert got.filter("n <> k").count() == 0 and got.count() == 1000
