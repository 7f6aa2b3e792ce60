"""Parsing and call graphs over source files derived from the part table.

Twenty parts make one file; the file's number picks its language.  Every part becomes a
four-line definition with a comment above it and one call inside, so the expected symbols
and edges can be written down in SQL from the part rows alone.
"""

from pyspark.sql import functions as F

from ..operators import aggregates, cobol, ordering, parse, topk
from ..plans import questions, search
from ..sources import prebuilt
from . import registry as R
from .registry import joined, query, table

c = F.col
LANGS = ("c", "java", "csharp", "javascript", "python", "sql", "cobol", "tal", "go", "rust")
EXTS = ("c", "java", "cs", "js", "py", "sql", "cbl", "tal", "go", "rs")
# comment line, definition line, call line, closing line; {n} name, {k} callee, {d} description
SNIPPETS = {
    "c": ("// Reads the {d} value", "int {n}(int a) {", "  return {k}(a);", "}"),
    "java": ("// Reads the {d} value", "public int {n}(int a) {", "  return {k}(a);", "}"),
    "csharp": ("// Reads the {d} value", "public int {n}(int a) {", "  return {k}(a);", "}"),
    "javascript": ("// Reads the {d} value", "function {n}(a) {", "  return {k}(a);", "}"),
    "python": ("# Reads the {d} value", "def {n}(a, b):", "    return {k}(a)", ""),
    "sql": ("-- Reads the {d} value", "CREATE FUNCTION {n}(a INT) AS", "BEGIN {k}(a)", "END;"),
    "cobol": ("      * Reads the {d} value", "       {n}.", "           PERFORM {k}.", "      *"),
    "tal": ("-- Reads the {d} value", "PROC {n};", "BEGIN CALL {k};", "END;"),
    "go": ("// Reads the {d} value", "func {n}(a int) int {", "  return {k}(a)", "}"),
    "rust": ("// Reads the {d} value", "fn {n}(a: i32) -> i32 {", "  {k}(a)", "}"),
}


def _fill(template, n, k, d):
    out, rest = [], template
    while rest:
        cuts = [(rest.find(m), m) for m in ("{n}", "{k}", "{d}") if m in rest]
        if not cuts:
            out.append(F.lit(rest))
            break
        at, m = min(cuts)
        if at:
            out.append(F.lit(rest[:at]))
        out.append({"{n}": n, "{k}": k, "{d}": d}[m])
        rest = rest[at + 3:]
    return F.concat(*out) if out else F.lit("")


def code_corpus(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.floor(c("p_partkey") / 20).alias("file_no"))
    slot = (c("file_no") % len(LANGS)).cast("int")
    lang = F.get(F.array(*[F.lit(x) for x in LANGS]), slot)
    low = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), (c("p_partkey") % 20).cast("string"))
    name = F.when(lang == "cobol", F.upper(F.replace(low, F.lit("_"), F.lit("-")))).otherwise(low)
    callee = F.when(lang == "cobol", F.concat(F.lit("CALL-"), c("p_size").cast("string"))).otherwise(F.concat(F.lit("call_"), c("p_size").cast("string")))
    body = None
    for code, lines in SNIPPETS.items():
        piece = F.concat_ws("\n", *[_fill(t, name, callee, c("p_name")) for t in lines])
        body = F.when(lang == code, piece) if body is None else body.when(lang == code, piece)
    rows = p.select("file_no", slot.alias("slot"), lang.alias("language"), "p_partkey", body.alias("piece"))
    files = rows.groupBy("file_no", "slot", "language").agg(  # twenty rows per file
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))), lambda x: x["piece"]), "\n").alias("content"))
    ext = F.get(F.array(*[F.lit(x) for x in EXTS]), c("slot"))
    return files.select(F.concat(F.lit("src/m"), (c("file_no") % 7).cast("string"), F.lit("/f"), c("file_no").cast("string"), F.lit("."), ext).alias("path"),
                        "content", "language", c("file_no").alias("ord"))


CODE = f"""SELECT p_partkey, p_name, fno, k % 10 AS slot, {list(LANGS)}[k % 10 + 1] AS language, 'src/m' || fno % 7 || '/f' || fno || '.' || {list(EXTS)}[k % 10 + 1] AS path, (p_partkey % 20) * 4 AS base,
 CASE WHEN k % 10 = 6 THEN upper(replace(replace(p_name, ' ', '-') || '-' || p_partkey % 20, '_', '-')) ELSE replace(p_name, ' ', '_') || '_' || p_partkey % 20 END AS n,
 CASE WHEN k % 10 = 6 THEN 'CALL-' || p_size ELSE 'call_' || p_size END AS callee FROM (SELECT *, p_partkey // 20 AS fno, p_partkey // 20 AS k FROM part)"""
TYPES = {"c": "function", "java": "method", "csharp": "method", "javascript": "function", "python": "function", "sql": "function", "cobol": "paragraph", "tal": "procedure",
         "go": "function", "rust": "function"}
TYPE_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
# typed-method patterns also read "return callee(a)" as a method that starts on the definition's line
SYMS = f"SELECT path, language, n AS name, {TYPE_SQL} AS type, base + 2 AS line, p_partkey FROM ({CODE}) UNION ALL SELECT path, language, callee, 'method', base + 2, p_partkey FROM ({CODE}) WHERE language IN ('java', 'csharp')"


@query("prs_12_parse_symbols", f"SELECT path AS file, name, type, line FROM ({SYMS})")
def _(spark, sf):
    s = parse.parse_symbols(code_corpus(spark, sf), with_summary=False)
    return s.select("file", "name", "type", c("line").cast("bigint").alias("line"))


for _no, _lang in zip(("01", "02", "03", "04", "05", "06", "07", "08", "09", "10"), ("c", "java", "csharp", "javascript", "python", "sql", "cobol", "tal", "go", "rust")):
    def _one(spark, sf, lang=_lang):
        s = parse.parse_symbols(code_corpus(spark, sf).filter(c("language") == lang), with_summary=False)
        return s.groupBy("file").agg(F.count("*").alias("symbols"), F.min("line").cast("bigint").alias("first"), F.max("line").cast("bigint").alias("last"), F.min("name").alias("name"))
    query(f"prs_{_no}_parse_{_lang}", f"SELECT path AS file, count(*) AS symbols, min(line) AS first, max(line) AS last, min(name) AS name FROM ({SYMS}) WHERE language = '{_lang}' GROUP BY path")(_one)


@query("prs_11_parse_generic", f"SELECT path AS file, name, line FROM (SELECT path, n AS name, base + 2 AS line, language FROM ({CODE})) WHERE language IN ('javascript', 'python', 'sql', 'tal')")
def _(spark, sf):
    files = code_corpus(spark, sf).withColumn("language", F.lit("unknown"))
    return parse.parse_symbols(files, with_summary=False).select("file", "name", c("line").cast("bigint").alias("line"))


@query("prs_13_comment_summaries", f"SELECT s.path AS file, name, 'Reads the ' || p_name || ' value' AS summary FROM ({SYMS}) s JOIN part USING (p_partkey)")
def _(spark, sf):
    return parse.parse_symbols(code_corpus(spark, sf)).select("file", "name", "summary")


def _table(spark, sf):
    return parse.symbol_table(parse.parse_symbols(code_corpus(spark, sf), with_summary=False))


KEYED = f"SELECT name || '@' || path AS key, max(line) AS line, arg_max(type, p_partkey) AS type, count(*) AS n, max(p_partkey) AS last FROM ({SYMS}) GROUP BY 1"


@query("idx_02_symbol_table", f"SELECT key, line, type FROM ({KEYED})")
def _(spark, sf):
    return _table(spark, sf).select("key", c("line").cast("bigint").alias("line"), "type")


ENDS = f"""SELECT path, n AS name, least(80, CASE WHEN language = 'cobol' AND base < 76 THEN base + 6 WHEN language = 'cobol' THEN 80 ELSE base + 5 END) AS end_line FROM ({CODE})
 UNION ALL SELECT path, callee, least(80, max(base) + 5) FROM ({CODE}) WHERE language IN ('java', 'csharp') GROUP BY path, callee"""


@query("prs_18_body_ends", ENDS)
def _(spark, sf):
    return parse.body_ends(ordering.cut_lineage(_table(spark, sf)), code_corpus(spark, sf)).select("path", "name", c("end_line").cast("bigint").alias("end_line"))


@query("prs_17_calls_in_text", f"SELECT path, array_to_string(list_sort(list_distinct(list(x))), '|') AS calls FROM (SELECT path, callee AS x FROM ({CODE}) UNION ALL SELECT path, n FROM ({CODE}) WHERE language NOT IN ('cobol', 'tal')) GROUP BY path")
def _(spark, sf):
    return code_corpus(spark, sf).select("path", joined(F.array_sort(parse.extract_calls(c("content"), c("language")))).alias("calls"))


CEDGES = f"SELECT DISTINCT caller, callee FROM (SELECT n AS caller, callee FROM ({CODE}) UNION ALL SELECT callee, arg_max(n, p_partkey) FROM ({CODE}) WHERE language IN ('java', 'csharp') GROUP BY path, callee)"


@query("idx_03_call_graph", CEDGES)
def _(spark, sf):
    files = code_corpus(spark, sf)
    return parse.call_edges(parse.call_lists(ordering.cut_lineage(_table(spark, sf)), files)).select("caller", "callee")


@query("grf_01_reference_mode", f"SELECT caller, callee FROM (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY o DESC) AS rn FROM (SELECT n AS caller, callee, p_partkey AS o FROM ({CODE}) UNION ALL SELECT callee, arg_max(n, p_partkey), max(p_partkey) FROM ({CODE}) WHERE language IN ('java', 'csharp') GROUP BY path, callee)) WHERE rn = 1")
def _(spark, sf):
    files = code_corpus(spark, sf)
    return parse.call_edges(parse.call_lists(ordering.cut_lineage(_table(spark, sf)), files), "reference").select("caller", "callee")


@query("prs_19_line_functions", f"SELECT path, CASE language WHEN 'java' THEN n ELSE n END AS name, base + 2 AS line FROM ({CODE}) WHERE language IN ('tal', 'cobol', 'java', 'python', 'javascript') UNION ALL SELECT path, callee, base + 3 FROM ({CODE}) WHERE language = 'java'")
def _(spark, sf):
    return parse.line_functions(code_corpus(spark, sf)).select("path", "name", c("line").cast("bigint").alias("line"))


@query("src_18_prebuilt_index", f"SELECT path, 80::BIGINT AS lines, sum(CASE WHEN language = 'java' THEN 2 WHEN language IN ('tal', 'cobol', 'python', 'javascript') THEN 1 ELSE 0 END)::BIGINT AS functions FROM ({CODE}) GROUP BY path")
def _(spark, sf):
    b = prebuilt.build(code_corpus(spark, sf))
    return b.select("path", c("lines").cast("bigint").alias("lines"), F.coalesce(F.size("functions"), F.lit(0)).cast("bigint").alias("functions"))


@query("agg_06_symbol_stats", f"WITH k AS ({KEYED}) SELECT count(*) AS symbols, count_if(type IN ('function', 'procedure', 'method'))::BIGINT AS functions, 0::BIGINT AS classes, 0::BIGINT AS variables FROM k")
def _(spark, sf):
    return aggregates.symbol_stats(_table(spark, sf)).select("symbols", "functions", "classes", "variables")


@query("agg_07_type_counts", f"SELECT type, count(*) AS n FROM ({KEYED}) GROUP BY type")
def _(spark, sf):
    return aggregates.type_counts(_table(spark, sf))


def _cobol_corpus(spark, sf):
    """Parts as COBOL data and SQL: one program per twenty parts."""
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("n"), "p_size", F.floor(c("p_partkey") / 20).alias("f"))
    size = c("p_size").cast("string")
    piece = F.concat(F.lit("       05 "), c("n"), F.lit(" OCCURS "), size, F.lit(" TIMES INDEXED BY IX"), size, F.lit(".\n           EXEC SQL SELECT A FROM T"), size,
                     F.lit(" END-EXEC.\n           EXEC SQL UPDATE T"), size, F.lit(" SET A = 1 END-EXEC.\n       FD  F-"), size, F.lit("."))
    files = p.select("f", "p_partkey", piece.alias("piece")).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))).alias("x"))
    return files.select(F.concat(F.lit("cob/prog"), c("f").cast("string"), F.lit(".cbl")).alias("path"),
                        F.concat(F.lit("       PROGRAM-ID. MOD-"), c("f").cast("string"), F.lit(".\n"), F.array_join(F.transform("x", lambda x: x["piece"]), "\n")).alias("content"),
                        F.lit("cobol").alias("language"), c("f").alias("ord"))


COB = "SELECT p_partkey // 20 AS f, 'cob/prog' || p_partkey // 20 || '.cbl' AS path, upper(replace(p_name, ' ', '-')) AS n, p_size, 2 + (p_partkey % 20) * 4 AS line FROM part"


@query("prs_20_cobol_data_items", f"SELECT path, n AS name, line FROM ({COB})")
def _(spark, sf):
    found = cobol.inventory(_cobol_corpus(spark, sf)).filter("kind = 'data_item'")
    return found.select("path", "name", c("line").cast("bigint").alias("line"))


@query("prs_20_occurs_tables", f"SELECT path, n AS name, p_size::BIGINT AS max_occurs, 'IX' || p_size AS indexes, line FROM ({COB})")
def _(spark, sf):
    t = cobol.occurs_tables(cobol.inventory(_cobol_corpus(spark, sf)))
    return t.select("path", "name", c("max_occurs").cast("bigint").alias("max_occurs"), joined("indexes").alias("indexes"), c("line").cast("bigint").alias("line"))


@query("agg_13_sql_tables", f"SELECT path, 'T' || p_size AS name, 'SELECT|UPDATE' AS operations, min(line) + 1 AS line FROM ({COB}) WHERE p_size >= 1 GROUP BY 1, 2")
def _(spark, sf):
    t = cobol.sql_tables(cobol.inventory(_cobol_corpus(spark, sf)))
    return t.select("path", "name", joined("operations").alias("operations"), c("line").cast("bigint").alias("line"))


_ALL = f"SELECT path, 'cobol' AS source, n AS name, line FROM ({COB}) UNION ALL SELECT path, 'sql', 'T' || p_size, min(line) + 1 FROM ({COB}) GROUP BY path, p_size UNION ALL SELECT path, 'file', 'F-' || p_size, line + 3 FROM ({COB})"


def _all_tables(spark, sf):
    return cobol.all_tables(cobol.inventory(_cobol_corpus(spark, sf)))


@query("grf_13_cobol_table_counts", f"SELECT source, count(*) AS n FROM ({_ALL}) GROUP BY source")
def _(spark, sf):
    return cobol.table_counts(_all_tables(spark, sf))


@query("prj_14_search_cobol_tables", f"SELECT path, source, name FROM ({_ALL}) WHERE regexp_matches(name, '(?i)^red|T1')")
def _(spark, sf):
    return cobol.search_tables(_all_tables(spark, sf), "^red|T1").select("path", "source", "name")


@query("prj_15_cobol_tables_in_file", f"SELECT source, name FROM ({_ALL}) WHERE path = (SELECT max(path) FROM ({_ALL}))")
def _(spark, sf):
    t = _all_tables(spark, sf)
    return t.filter(c("path") == t.agg(F.max("path")).scalar()).select("source", "name")


@query("joi_13_tables_in_module", f"SELECT source, name, line FROM ({_ALL}) WHERE path = 'cob/prog7.cbl'")
def _(spark, sf):
    f = _cobol_corpus(spark, sf)
    found = cobol.inventory(f)
    return cobol.tables_in_module(cobol.modules(f, found), cobol.all_tables(found), "mod-7").select("source", "name", c("line").cast("bigint").alias("line"))


@query("prs_20_inventory_counts", f"SELECT count(DISTINCT f) AS programs, count(DISTINCT n) AS data_items, count(*) AS cobol_tables, (SELECT count(*) FROM (SELECT DISTINCT path, p_size FROM ({COB}))) AS sql_tables FROM ({COB})")
def _(spark, sf):
    return cobol.counts(cobol.inventory(_cobol_corpus(spark, sf))).select("programs", "data_items", "cobol_tables", "sql_tables")


# --- whole plans (rows only) ---------------------------------------------------------------

def _index(spark, sf):
    return search.build_index(ordering.cut_lineage(code_corpus(spark, sf)))  # files as a stored table


_LINES = ("SELECT path, base + i AS line, lower(replace(replace(replace(tpl[i], '{n}', n), '{k}', callee), '{d}', p_name)) AS t FROM (SELECT *, CASE language "
          + " ".join("WHEN '%s' THEN [%s]" % (k, ", ".join("'%s'" % x for x in v)) for k, v in SNIPPETS.items()) + f" END AS tpl, unnest([1, 2, 3, 4]) AS i FROM ({CODE}))")


def _search_sql(terms, extra=()):
    """(key, leg, match_score, match_source) of all symbols that a query of these terms finds.

    One of the terms must be "call": every definition has a call line, so the code leg finds all symbols that no leg before it has, and the term
    postings behind it add none.
    """
    every = [*terms, *[t for t in extra if t not in terms]]
    words = "(VALUES " + ", ".join(f"({i}, '{t}', {'true' if t in extra else 'false'}, {'true' if t in terms else 'false'})" for i, t in enumerate(every)) + ") AS w(no, term, extra, own)"
    return f"""WITH w AS (SELECT * FROM {words}), s AS (SELECT name || '@' || path AS key, lower(name) AS nm, path, max(line) AS line FROM ({SYMS}) GROUP BY name, path),
 f AS (SELECT DISTINCT path, 'f' || fno AS stem, 'm' || fno % 7 AS dir FROM ({CODE})),
 forms AS (SELECT term AS form FROM w WHERE own AND length(term) >= 3),
 concept AS (SELECT DISTINCT path FROM f, forms WHERE stem = form OR stem = form || 's' OR (starts_with(stem, form) AND length(stem) < length(form) + 8)),
 dirs AS (SELECT DISTINCT path FROM f, w WHERE own AND (contains(dir, term) OR contains(term, dir) OR contains('src', term) OR contains(term, 'src')) AND path NOT IN (SELECT path FROM concept)),
 hits AS (SELECT DISTINCT l.path, l.line FROM ({_LINES}) l, w WHERE own AND length(replace(term, '_', '')) >= 3 AND contains(l.t, term)),
 legs AS (SELECT key, 0 AS leg, 0 AS no, 95.0 AS sc, 'concept_file' AS src FROM s WHERE path IN (SELECT path FROM concept)
  UNION ALL SELECT key, 1, no, CASE WHEN extra THEN 98.0 ELSE 100.0 END, CASE WHEN extra THEN 'expanded_match' ELSE 'exact_match' END FROM s JOIN w ON nm = term
  UNION ALL SELECT key, 2, no, CASE WHEN nm = term THEN 100.0 WHEN starts_with(nm, term) THEN 90.0 ELSE 70.0 END, 'pattern_match' FROM s JOIN w ON length(term) >= 3 AND contains(nm, term)
  UNION ALL SELECT key, 3, 0, 75.0, 'directory_match' FROM s WHERE path IN (SELECT path FROM dirs)
  UNION ALL SELECT key, 4, 0, 70.0, 'trigram_code' FROM s WHERE EXISTS (SELECT 1 FROM hits h WHERE h.path = s.path AND abs(h.line - s.line) <= 50))
SELECT key, leg, sc::DOUBLE AS match_score, src AS match_source FROM legs QUALIFY row_number() OVER (PARTITION BY key ORDER BY leg, no) = 1"""


#: Queries over the code corpus, with the terms that they have.
ASKED = (("small ring f70 call_7", ("small", "ring", "f70", "call_7", "call")), ("m3x call", ("m3x", "call")), ("who calls f1 call_20", ("calls", "f1", "call_20", "call")))
CALLED = f"SELECT caller AS name, callee FROM ({CEDGES})"


@query("rnk_06_unified_search", f"SELECT key, match_score, match_source FROM ({_search_sql(ASKED[0][1])})")
def _(spark, sf):
    symbols, _ = search.unified_search(_index(spark, sf), ASKED[0][0], max_results=None)
    return symbols.select("key", "match_score", "match_source")


@query("rnk_06_unified_files", f"SELECT DISTINCT path, CASE WHEN 'f' || fno IN ('f70', 'f70s') THEN 'concept_exact' ELSE 'concept_prefix' END AS match_source FROM ({CODE}) WHERE starts_with('f' || fno, 'f70') AND length('f' || fno) < 11")
def _(spark, sf):
    return search.unified_search(_index(spark, sf), ASKED[0][0])[1].filter("leg = 0").select("path", "match_source")


@query("rnk_14_batched_questions", " UNION ALL ".join(f"SELECT {i} AS question, key, match_score, match_source FROM ({_search_sql(t)})" for i, (_, t) in enumerate(ASKED)))
def _(spark, sf):
    found, _ = questions.search_questions(_index(spark, sf), questions.asked(spark, [q for q, _ in ASKED]))
    return found.select(c("question").cast("int").alias("question"), "key", "match_score", "match_source")


@query("rnk_14_questions_top", " UNION ALL ".join(f"SELECT {i} AS question, least(count(*), {n})::BIGINT AS n, min(match_score) AS lowest FROM (SELECT match_score FROM ({_search_sql(t)}) ORDER BY 1 DESC LIMIT {n})"
                                                  for i, ((_, t), n) in enumerate(zip(ASKED, (7, 40, 1)))))
def _(spark, sf):
    asks = questions.asked(spark, [(q, n) for (q, _), n in zip(ASKED, (7, 40, 1), strict=True)])
    found, _ = questions.search_questions(_index(spark, sf), asks)
    return found.groupBy(c("question").cast("int").alias("question")).agg(F.count("*").alias("n"), F.min("match_score").alias("lowest"))


@query("rnk_13_execute_search", f"SELECT name FROM ({CALLED}) WHERE callee = 'call_7'")
def _(spark, sf):
    return search.execute_search(_index(spark, sf), "who calls call_7")["callers"].select("name")


@query("rnk_13_batched_callers", " UNION ALL ".join(f"SELECT {i} AS question, 'caller' AS side, name FROM ({CALLED}) WHERE callee = 'call_{n}'" for i, n in ((0, 7), (1, 20)))
       + f" UNION ALL SELECT 2, 'callee', callee FROM ({CALLED}) WHERE name = 'call_9'")
def _(spark, sf):
    asks = questions.kinds(questions.asked(spark, ["who calls call_7", "who calls call_20", "what does call_9 call"]))
    ix = _index(spark, sf)
    return questions.callers(ix.edges, asks, parse.first_definitions(ix.symbols)).select(c("question").cast("int").alias("question"), "side", "name").distinct()


@query("rnk_15_code_search", f"SELECT name, path AS file, min(leg) AS leg FROM (SELECT s.name, s.path, 0 AS leg FROM ({_search_sql(ASKED[0][1])}) q JOIN (SELECT DISTINCT name, path FROM ({SYMS})) s ON q.key = s.name || '@' || s.path) GROUP BY 1, 2")
def _(spark, sf):
    found = search.code_search(_index(spark, sf), ASKED[0][0], ["gear"], max_results=None, per_name=None)
    return found.select("name", "file", c("ord.leg").cast("int").alias("leg"))


@query("rnk_30_functionality_search", f"SELECT key, leg::INT AS leg, match_score FROM (SELECT key, 0 AS leg, match_score FROM ({_search_sql(ASKED[1][1])}))")
def _(spark, sf):
    found = search.functionality_search(_index(spark, sf), ASKED[1][0], ["small"], business=True, max_results=None)
    return found.select("key", c("leg").cast("int").alias("leg"), "match_score")


_COMBINED = ((0, "call_7"), (1, "call_20"))


@query("ctx_08_enrichments", " UNION ALL ".join(f"SELECT {i} AS question, 'caller' AS part, name FROM ({CALLED}) WHERE callee = '{n}'" for i, n in _COMBINED) + " UNION ALL "
       + " UNION ALL ".join(f"SELECT {i}, 'call_site', '{n}' FROM ({CODE}) WHERE callee = '{n}' AND language NOT IN ('cobol')" for i, n in _COMBINED))
def _(spark, sf):
    asks = questions.kinds(questions.asked(spark, [f"who calls {n}" for _, n in _COMBINED]))
    return questions.enrichments(_index(spark, sf), asks).select("question", "part", "name")


@query("ctx_07_combined_parts")
def _(spark, sf):
    found = questions.combined(_index(spark, sf), questions.asked(spark, [f"who calls {n}" for _, n in _COMBINED]))
    return found.filter("part <> 'symbol' or place <= 20").select("question", "part", "place", "key", "name", "file", "line", "score", "source")


@query("top_02_merge_blocks", f"""WITH RECURSIVE b AS (SELECT file, name, ord::BIGINT AS ord, line::BIGINT AS lo, line + ord % 12 + 1 AS hi, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM ({R.SYMBOLS})),
 f(file, rn, kept) AS (SELECT DISTINCT file, 0::BIGINT, []::STRUCT(lo BIGINT, hi BIGINT, ord BIGINT)[] FROM b UNION ALL
 SELECT file, rn, CASE WHEN place > 0 THEN list_transform(kept, lambda s, i: CASE WHEN i = place AND hi - lo > s.hi - s.lo THEN {{'lo': lo, 'hi': hi, 'ord': ord}} ELSE s END) ELSE list_append(kept, {{'lo': lo, 'hi': hi, 'ord': ord}}) END
 FROM (SELECT f.file, b.rn, kept, lo, hi, ord, coalesce(list_position(list_transform(kept, lambda s: lo <= s.hi + 5 AND hi >= s.lo - 5), true), 0) AS place FROM f JOIN b ON b.file = f.file AND b.rn = f.rn + 1)),
 w AS (SELECT file, unnest(arg_max(kept, rn)).ord AS ord FROM f GROUP BY file) SELECT b.file, b.lo AS line, b.name FROM w JOIN b USING (ord)""")
def _(spark, sf):
    s = R.symbols(spark, sf)
    blocks = s.select("file", "line", "name", "ord", F.array_join(F.array_repeat(F.lit("x"), (c("ord") % 12 + 1).cast("int")), "\n").alias("code"))
    return topk.merge_blocks(blocks).select("file", "line", "name")
