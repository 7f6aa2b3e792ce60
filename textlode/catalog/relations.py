"""Joins and graph operators over parts, events and documents."""

from pyspark.sql import functions as F

from ..operators import context, graph, grep, joins, parse, topk
from ..plans import scope, search
from . import registry as R
from .registry import corpus, edges, joined, query, symbols, table

c = F.col
BIG = lambda *names: [c(n).cast("bigint").alias(n) for n in names]

# hits: lineitem rows as (file, line) positions among the symbols
_HIT_FILE = "'src/' || ['economy', 'small', 'medium', 'promo', 'large', 'standard'][l_partkey % 6 + 1] || '/brand_' || (l_suppkey % 25 + 1) || '.c'"
_HITS = f"SELECT DISTINCT {_HIT_FILE} AS path, l_quantity::BIGINT * 10 AS line FROM lineitem"


def _hits(spark, sf):
    t = table(spark, sf, "lineitem")
    kind = F.get(F.array(*[F.lit(x) for x in ("economy", "small", "medium", "promo", "large", "standard")]), (c("l_partkey") % 6).cast("int"))
    return t.select(F.concat(F.lit("src/"), kind, F.lit("/brand_"), (c("l_suppkey") % 25 + 1).cast("string"), F.lit(".c")).alias("path"),
                    (c("l_quantity").cast("int") * 10).alias("line")).distinct()


@query("joi_03_symbols_near_line", f"SELECT h.path, h.line, count(*) AS near, min(s.key) AS first_key FROM ({_HITS}) h JOIN ({R.SYMBOLS}) s ON s.file = h.path AND abs(s.line - h.line) <= 50 GROUP BY 1, 2")
def _(spark, sf):
    n = joins.symbols_near(_hits(spark, sf), symbols(spark, sf))
    return n.groupBy("path", c("line").cast("bigint").alias("line")).agg(F.count("*").alias("near"), F.min("symbol.key").alias("first_key"))


@query("joi_04_nearest_symbol", f"SELECT path, line, arg_min(key, (d, ord)) AS key FROM (SELECT h.path, h.line, s.key, s.ord, abs(s.line - h.line) AS d FROM ({_HITS}) h JOIN ({R.SYMBOLS}) s ON s.file = h.path AND abs(s.line - h.line) < 50) GROUP BY 1, 2")
def _(spark, sf):
    n = joins.nearest_symbol(_hits(spark, sf), symbols(spark, sf))
    return n.select("path", *BIG("line"), c("symbol.key").alias("key"))


@query("joi_05_enclosing_definition", f"SELECT path, line, max(dl) AS enclosing_line FROM (SELECT l.path, l.line, d.line AS dl FROM (SELECT path, line FROM ({R.LINES}) WHERE contains(text, '555')) l LEFT JOIN "
       f"(SELECT path, line FROM ({R.LINES}) WHERE regexp_matches(text, '^\\s*(?:public|private|protected)?\\s*(?:static\\s+)?(\\w+)\\s+(\\w+)\\s*\\(')) d ON d.path = l.path AND d.line <= l.line AND d.line > l.line - 100) GROUP BY 1, 2")
def _(spark, sf):
    files = corpus(spark, sf)
    hits = grep.corpus_lines(files).filter(F.contains("text", F.lit("555"))).select("path", "line", "ord")
    return grep.enclosing_functions(hits, files).select("path", *BIG("line", "enclosing_line"))


@query("joi_01_postings_to_documents", f"SELECT lang, term, count(*) AS docs, sum(tf)::BIGINT AS tf FROM (SELECT ord AS doc_id, term, tf FROM ({R.TF})) JOIN documents USING (doc_id) GROUP BY 1, 2")
def _(spark, sf):
    from ..operators import index
    tf = index.term_frequencies(corpus(spark, sf).repartition("ord"), ("ord",))  # dealt once, before the texts are cut
    return tf.join(table(spark, sf, "documents").select(c("doc_id").alias("ord"), "lang"), "ord").groupBy("lang", "term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query("joi_09_in_scope", f"SELECT path FROM ({R.DOCS}) WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    files = corpus(spark, sf)
    good = files.join(table(spark, sf, "labels").filter("quality = 1").select(c("doc_id").alias("ord")), "ord", "left_semi").select("path")
    s = scope.Scope()
    s.activate("good", good)
    return s.filter(files, "path").select("path")


@query("joi_10_scope_by_suffix", f"SELECT path FROM ({R.DOCS}) WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    files = corpus(spark, sf)
    chosen = table(spark, sf, "labels").filter("quality = 1").join(files.withColumnRenamed("ord", "doc_id"), "doc_id") \
        .select(F.concat(F.lit("/home/me/work/"), F.substring_index("path", "/", -2)).alias("path"))
    s = scope.Scope()
    s.activate("good", chosen)
    return s.files(files).select("path")


@query("joi_11_scope_by_name", f"SELECT path FROM ({R.DOCS}) WHERE ord IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    files = corpus(spark, sf)
    names = table(spark, sf, "labels").filter("toxic = 1").select(F.concat(F.lit("elsewhere/"), c("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return joins.in_scope_by_suffix(files, names).select("path")


@query("cls_12_explicit_selection", "SELECT count(*) AS files FROM labels WHERE quality = 1")
def _(spark, sf):
    chosen = corpus(spark, sf).join(table(spark, sf, "labels").filter("quality = 1").select(c("doc_id").alias("ord")), "ord", "left_semi")
    s = scope.Scope()
    scope.select_paths(s, "good", chosen)
    return s.paths.agg(F.count("*").alias("files"))


@query("top_10_auto_select", f"SELECT file FROM (SELECT file, count(*) * 9 AS score, min(ord) AS ord FROM ({R.SYMBOLS}) GROUP BY file) WHERE score >= greatest(30, 0.4 * (SELECT max(n) * 9 FROM (SELECT count(*) AS n FROM ({R.SYMBOLS}) GROUP BY file))) ORDER BY score DESC, ord LIMIT 30")
def _(spark, sf):
    f = symbols(spark, sf).groupBy("file").agg((F.count("*") * 9).alias("score"), F.min("ord").alias("ord")).withColumn("source", F.lit("grep"))
    return topk.auto_select(f).select("file")


# --- dedupe and lookups -----------------------------------------------------------------------

@query("top_01_dedupe_symbols", f"SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM (SELECT arg_min(key, ord) AS key, arg_min(name, ord) AS name, min(ord) AS ord FROM ({R.SYMBOLS}) GROUP BY file, line)) WHERE rn <= 3")
def _(spark, sf):
    return topk.dedupe_symbols(symbols(spark, sf)).select("key")


@query("top_03_distinct_files", f"SELECT file, min(ord) AS first FROM ({R.SYMBOLS}) GROUP BY file")
def _(spark, sf):
    return symbols(spark, sf).groupBy("file").agg(F.min("ord").alias("first"))


_BUCKET = lambda k, n: f"SELECT key FROM (SELECT arg_min(key, ord) AS key, min(ord) AS ord FROM ({R.SYMBOLS}) GROUP BY file, line // {k}) ORDER BY ord LIMIT {n}"


@query("top_04_blocks_by_20", _BUCKET(20, 25))
def _(spark, sf):
    return topk.dedupe_blocks(symbols(spark, sf), 20, 25).select("key")


@query("top_05_blocks_by_15", _BUCKET(15, 20))
def _(spark, sf):
    return topk.dedupe_blocks(symbols(spark, sf), 15, 20).select("key")


@query("top_06_dedupe_hits", f"SELECT file, line, arg_min(key, ord) AS key FROM ({R.SYMBOLS}) GROUP BY 1, 2")
def _(spark, sf):
    return topk.dedupe_hits(symbols(spark, sf).withColumnRenamed("file", "path")).select(c("path").alias("file"), *BIG("line"), "key")


@query("top_08_dedupe_and_limit", f"SELECT key FROM (SELECT arg_min(key, ord) AS key, min(ord) AS ord FROM ({R.SYMBOLS}) GROUP BY file, line) ORDER BY ord LIMIT 100")
def _(spark, sf):
    return topk.dedupe_and_limit(symbols(spark, sf).withColumnRenamed("file", "path"), 100).select("key")


@query("top_16_posting_intersection", f"SELECT key FROM ({R.SYMBOLS}) WHERE contains(replace(name, '_', ''), 'bolt')")
def _(spark, sf):
    from ..operators import index
    t = index.symbol_trigrams(symbols(spark, sf)).filter(c("tri").isin("bol", "olt"))
    return t.groupBy("key").agg(F.count("*").alias("n")).filter("n = 2").select("key")


@query("top_17_calls_except_self", "SELECT user_id, array_to_string(list_sort(list_filter(list(DISTINCT event_type), lambda t: t NOT IN ('view', 'error'))), '|') AS kinds FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", joined(F.array_sort(F.array_except("s", F.array(F.lit("view"), F.lit("error"))))).alias("kinds"))


@query("prj_06_symbols_in_files", f"SELECT key FROM ({R.SYMBOLS}) WHERE contains(file, 'brand_1')")
def _(spark, sf):
    return symbols(spark, sf).filter(F.contains(F.lower("file"), F.lit("brand_1"))).select("key")


@query("prj_07_first_100_per_file", f"SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM ({R.SYMBOLS})) WHERE rn <= 100")
def _(spark, sf):
    from ..operators import ordering
    return ordering.top_per_key(symbols(spark, sf), ["file"], ["ord"], 100).select("key")


@query("prj_08_symbol_by_key", f"SELECT key, name, line FROM ({R.SYMBOLS}) WHERE key IN (SELECT max(key) FROM ({R.SYMBOLS}))")
def _(spark, sf):
    s = symbols(spark, sf)
    return s.filter(c("key") == s.agg(F.max("key")).scalar()).select("key", "name", *BIG("line"))


@query("prj_09_symbols_by_name", f"SELECT key FROM ({R.SYMBOLS}) WHERE name = 'red_widget'")
def _(spark, sf):
    return symbols(spark, sf).filter(F.lower("name") == "red_widget").select("key")


@query("prj_10_symbol_exact_or_ci", f"SELECT arg_min(key, ord) AS key FROM ({R.SYMBOLS}) WHERE lower(name) = 'red_widget'")
def _(spark, sf):
    s = symbols(spark, sf)
    rank_ = F.when(c("key") == "RED_widget", 0).when((F.lower("name") == "red_widget") | (F.lower("key") == "red_widget"), 1)
    return s.withColumn("r", rank_).filter("r is not null").agg(F.min_by("key", F.struct("r", "ord")).alias("key"))


_TL = f"SELECT ord, path, string_split(content, chr(10)) AS ls FROM ({R.DOCS})"


@query("prj_11_code_block", f"SELECT path, md5(array_to_string(ls[greatest(0, ln - 6) + 1:least(len(ls), ln + 40)], chr(10))) AS code FROM (SELECT *, len(ls) // 2 + 1 AS ln FROM ({_TL}))")
def _(spark, sf):
    f = corpus(spark, sf)
    s = f.select(c("path").alias("file"), (F.floor((F.size(F.split("content", "\n", -1))) / 2) + 1).cast("int").alias("line"))
    return context.code_blocks(s, f).select(c("file").alias("path"), F.md5("code").alias("code"))


@query("prj_12_raw_context", f"SELECT path, md5(array_to_string(ls[greatest(0, ln - 5) + 1:least(len(ls), ln + 30)], chr(10))) AS code FROM (SELECT *, len(ls) // 2 + 1 AS ln FROM ({_TL}))")
def _(spark, sf):
    f = corpus(spark, sf)
    s = f.select("path", (F.floor((F.size(F.split("content", "\n", -1))) / 2) + 1).cast("int").alias("line"))
    return context.raw_context(s, f).select("path", F.md5("code").alias("code"))


@query("prj_13_named_files", f"SELECT n AS asked, arg_min(path, ord) AS path FROM ({R.DOCS}), (SELECT unnest(['src1/', '/src3/fr/', '77.txt']) AS n) WHERE contains(path, ltrim(n, '/')) GROUP BY n")
def _(spark, sf):
    return joins.named_files(corpus(spark, sf), ["src1/", "/src3/fr/", "77.txt"]).select("asked", "path")


# --- graph ----------------------------------------------------------------------------------------

_DEFS = "SELECT 'fn_' || c_custkey AS name, 'src/' || lower(c_mktsegment) || '.c' AS file, c_nationkey AS line, CASE WHEN c_acctbal < 0 THEN 'method' ELSE 'function' END AS type FROM customer"


def _defs(spark, sf):
    k = table(spark, sf, "customer")
    return k.select(F.concat(F.lit("fn_"), c("c_custkey").cast("string")).alias("name"), F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit(".c")).alias("file"),
                    c("c_nationkey").alias("line"), F.when(c("c_acctbal") < 0, "method").otherwise("function").alias("type"))


def _many_defs(spark, sf):
    """Definitions with repeated names: customers 150 apart share one, the smallest key is the first."""
    k = table(spark, sf, "customer")
    return k.select(F.concat(F.lit("fn_"), (c("c_custkey") % 150).cast("string")).alias("name"), F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit(".c")).alias("file"),
                    c("c_nationkey").alias("line"), F.when(c("c_acctbal") < 0, "method").otherwise("function").alias("type"), c("c_custkey").alias("ord"))


_FIRST_DEFS = ("SELECT 'fn_' || (c_custkey % 150) AS name, arg_min('src/' || lower(c_mktsegment) || '.c', c_custkey) AS file, "
               "arg_min(CASE WHEN c_acctbal < 0 THEN 'method' ELSE 'function' END, c_custkey) AS type FROM customer GROUP BY 1")


@query("grf_01_edges", R.EDGES)
def _(spark, sf):
    return edges(spark, sf)


@query("grf_01_last_definition_wins", f"SELECT caller, callee FROM (SELECT caller, callee, day, max(day) OVER (PARTITION BY caller) AS last FROM (SELECT DISTINCT 'fn_' || user_id AS caller, event_type AS callee, strftime(ts, '%Y-%m-%d') AS day FROM events)) WHERE day = last")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("fn_"), c("user_id").cast("string")).alias("caller"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("ord"))
    lists = e.groupBy("caller", "ord").agg(F.collect_set("event_type").alias("calls"))
    return parse.call_edges(lists, "reference").select("caller", "callee")


@query("grf_02_callers", f"SELECT caller AS name FROM ({R.EDGES}) WHERE callee = 'fn_7'")
def _(spark, sf):
    return graph.callers(edges(spark, sf), "fn_7")


@query("grf_03_callees", f"SELECT callee AS name FROM ({R.EDGES}) WHERE caller = 'fn_7'")
def _(spark, sf):
    return graph.callees(edges(spark, sf), "fn_7")


@query("joi_16_callers_with_symbols", f"SELECT 'fn_7' AS matched_variant, caller AS name, file, type FROM ({R.EDGES}) LEFT JOIN ({_FIRST_DEFS}) ON name = caller WHERE callee = 'fn_7'")
def _(spark, sf):
    return graph.find_callers(edges(spark, sf), ["nope", "fn_7", "fn_8"], _many_defs(spark, sf)).select("matched_variant", "name", "file", "type")


@query("joi_17_callees_with_symbols", f"SELECT 'fn_8' AS matched_variant, callee AS name, file, type FROM ({R.EDGES}) LEFT JOIN ({_FIRST_DEFS}) ON name = callee WHERE caller = 'fn_8'")
def _(spark, sf):
    return graph.find_callees(edges(spark, sf), ["nope", "fn_8", "fn_7"], _many_defs(spark, sf)).select("matched_variant", "name", "file", "type")


@query("joi_18_first_variant_sites", "SELECT path FROM (" + R.PAGES + ") WHERE contains(content, 'track(') ORDER BY ord LIMIT 30")
def _(spark, sf):
    sites = grep.call_sites(R.page_corpus(spark, sf))
    return search.first_call_sites(sites, ["Track", "track", "tracks"]).select("path")


@query("joi_06_site_to_caller", f"SELECT s.path, arg_min(name, line) AS enclosing FROM (SELECT DISTINCT 'src/' || lower(c_mktsegment) || '.c' AS path FROM customer) s JOIN (SELECT * FROM ({_DEFS}) WHERE type = 'method') d ON d.file = s.path GROUP BY s.path HAVING true".replace("arg_min(name, line)", "arg_min(name, (line, name))"))
def _(spark, sf):
    d = _defs(spark, sf)
    return graph.caller_of_site(d.select(c("file").alias("path")).distinct(), d.filter("type = 'method'")).select("path", c("enclosing_name").alias("enclosing"))


@query("grf_04_trace", f"SELECT role, name, file FROM (SELECT 'symbol' AS role, name, file FROM ({_DEFS}) WHERE name = 'fn_7' UNION ALL SELECT 'caller', caller, file FROM ({R.EDGES}) LEFT JOIN ({_DEFS}) ON name = caller WHERE callee = 'fn_7' UNION ALL "
       f"SELECT 'callee', callee, file FROM ({R.EDGES}) LEFT JOIN ({_DEFS}) ON name = callee WHERE caller = 'fn_7')")
def _(spark, sf):
    return graph.trace(edges(spark, sf), "fn_7", _defs(spark, sf)).select("role", "name", "file")


@query("grf_05_neighbourhood", f"WITH RECURSIVE e AS MATERIALIZED (SELECT caller, callee FROM ({R.EDGES})), d AS (SELECT 'fn_7' AS n, 0 AS k UNION SELECT callee, k + 1 FROM d JOIN e ON caller = n WHERE k < 2), u AS (SELECT 'fn_7' AS n, 0 AS k UNION SELECT caller, k + 1 FROM u JOIN e ON callee = n WHERE k < 2) "
       "SELECT DISTINCT caller, callee FROM e WHERE caller IN (SELECT n FROM d) OR callee IN (SELECT n FROM u)")
def _(spark, sf):
    return graph.neighbourhood(edges(spark, sf), "fn_7", 2).select("caller", "callee")


@query("grf_06_entry_points", f"SELECT caller AS name, count(*) AS call_count, any_value(file) AS file FROM ({R.EDGES}) JOIN ({_FIRST_DEFS}) ON name = caller WHERE caller NOT IN (SELECT callee FROM ({R.EDGES})) GROUP BY caller")
def _(spark, sf):
    return graph.entry_points(edges(spark, sf), _many_defs(spark, sf)).select("name", "call_count", "file")


@query("grf_07_leaf_functions", f"SELECT caller AS name, count(*) AS caller_count, any_value(file) AS file FROM ({R.EDGES}) JOIN ({_FIRST_DEFS}) ON name = caller WHERE caller NOT IN (SELECT callee FROM ({R.EDGES})) GROUP BY caller")
def _(spark, sf):
    turned = edges(spark, sf).select(c("callee").alias("caller"), c("caller").alias("callee"), "ord")
    return graph.leaf_functions(turned, _many_defs(spark, sf)).select("name", "caller_count", "file")


@query("grf_08_call_paths", f"WITH RECURSIVE e AS MATERIALIZED (SELECT caller, callee FROM ({R.EDGES})), p AS (SELECT ['fn_7'] AS path UNION ALL SELECT list_append(path, callee) FROM p JOIN e ON caller = path[-1] WHERE len(path) <= 3 AND path[-1] <> 'fn_12' AND NOT list_contains(path, callee)) "
       "SELECT array_to_string(path, '>') AS path, len(path) AS length FROM p WHERE path[-1] = 'fn_12'")
def _(spark, sf):
    p = graph.call_paths(edges(spark, sf), "fn_7", "fn_12", 3)
    return p.select(joined("path", ">").alias("path"), *BIG("length"))


@query("grf_09_degree_stats", f"WITH e AS (SELECT * FROM ({R.EDGES})), o AS (SELECT caller, count(*) AS n FROM e GROUP BY 1), i AS (SELECT callee, count(*) AS n FROM e GROUP BY 1) SELECT (SELECT count(*) FROM o) AS functions, (SELECT count(*) FROM e) AS edges, "
       "round((SELECT count(*) FROM e) / (SELECT count(*) FROM o), 6) AS avg_out_degree, (SELECT max(n) FROM o) AS max_out_degree, (SELECT arg_max(caller, (n, caller)) FROM o) AS max_out_function, (SELECT max(n) FROM i) AS max_in_degree, (SELECT arg_max(callee, (n, callee)) FROM i) AS max_in_function")
def _(spark, sf):
    return graph.degree_stats(edges(spark, sf)).withColumn("avg_out_degree", F.round("avg_out_degree", 6))


@query("grf_10_scoped_edges", f"SELECT caller, callee FROM ({R.EDGES}) WHERE caller IN (SELECT name FROM ({_DEFS}) WHERE type = 'method') AND callee IN (SELECT name FROM ({_DEFS}) WHERE type = 'method')")
def _(spark, sf):
    return graph.induced(edges(spark, sf), _defs(spark, sf).filter("type = 'method'"))


@query("grf_11_mermaid", f"""WITH e AS (SELECT caller, callee FROM ({R.EDGES})), n AS (SELECT DISTINCT name FROM (SELECT caller AS name FROM e UNION ALL SELECT callee FROM e) ORDER BY name LIMIT 50),
 b AS (SELECT '    ' || regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') || '["' || name || '"]' AS t FROM n),
 a AS (SELECT '    ' || regexp_replace(caller, '[^a-zA-Z0-9_]', '_', 'g') || ' --> ' || regexp_replace(callee, '[^a-zA-Z0-9_]', '_', 'g') AS t FROM e WHERE caller IN (FROM n) AND callee IN (FROM n))
 SELECT 'graph TB' || chr(10) || (SELECT string_agg(t, chr(10) ORDER BY t) FROM b) || chr(10) || (SELECT coalesce(string_agg(t, chr(10) ORDER BY t), '') FROM a) AS diagram""")
def _(spark, sf):
    return graph.mermaid(edges(spark, sf))


@query("grf_14_node_model", f"SELECT name, coalesce(regexp_extract(file, '[^/]*$'), 'unknown') AS file, callees, callers, greatest(5, least(20, 5 + callees + callers)) AS size FROM (SELECT name, sum(o)::BIGINT AS callees, sum(i)::BIGINT AS callers FROM (SELECT caller AS name, 1 AS o, 0 AS i FROM ({R.EDGES}) UNION ALL SELECT callee, 0, 1 FROM ({R.EDGES})) GROUP BY name) LEFT JOIN ({_DEFS}) USING (name)")
def _(spark, sf):
    return graph.node_model(edges(spark, sf), _defs(spark, sf)).select("name", "file", *BIG("callees", "callers", "size"))


@query("grf_14_file_colours")
def _(spark, sf):
    return graph.file_colours(graph.node_model(edges(spark, sf), _defs(spark, sf)))
