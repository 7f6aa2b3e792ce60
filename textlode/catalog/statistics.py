"""Statistics, walks, listings and rendered reports."""

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import aggregates, context, grep, index, topk
from ..plans import models
from ..sources import files as filesrc
from . import registry as R
from .registry import corpus, page_corpus, query, symbols, table
from .search import _literal_sql

c = F.col
BIG = lambda *names: [c(n).cast("bigint").alias(n) for n in names]
_S = f"SELECT ord, path, content, language, '.txt' AS ext, split_part(path, '/', 1) AS top_dir, len(string_split(content, chr(10))) AS n_lines, length(content) AS size FROM ({R.DOCS})"


@query("agg_01_workspace_stats", f"SELECT CASE WHEN ext IS NOT NULL THEN 'extension' WHEN top_dir IS NOT NULL THEN 'directory' ELSE 'total' END AS level, coalesce(ext, top_dir, '') AS name, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(size)::BIGINT AS size FROM ({_S}) GROUP BY GROUPING SETS ((ext), (top_dir), ())")
def _(spark, sf):
    return aggregates.workspace_stats(corpus(spark, sf))


@query("agg_01_largest_files", f"SELECT path, n_lines, size FROM ({_S}) ORDER BY n_lines DESC, ord LIMIT 10")
def _(spark, sf):
    return aggregates.largest_files(corpus(spark, sf))


@query("agg_02_language_stats", f"SELECT language AS lang, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(size)::BIGINT AS size FROM ({_S}) GROUP BY language")
def _(spark, sf):
    return aggregates.language_stats(corpus(spark, sf), by_extension=False)


@query("agg_03_attachment_stats", f"SELECT count(*) AS count, sum(size)::BIGINT AS total_size, sum(n_lines)::BIGINT AS total_lines FROM ({_S})")
def _(spark, sf):
    return aggregates.attachment_stats(corpus(spark, sf))


@query("agg_05_group_by_file", f"SELECT path, count(*) AS hits, min(line) AS first_line, max(line) AS last_line FROM ({_literal_sql('ering')}) GROUP BY path")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "ering", max_results=None)
    return h.groupBy("path").agg(F.count("*").alias("hits"), F.min("line").cast("bigint").alias("first_line"), F.max("line").cast("bigint").alias("last_line"))


@query("agg_10_grep_stats", f"SELECT count(*) AS files, sum(len(string_split(content, chr(10))))::BIGINT AS total_lines, sum(length(content))::BIGINT AS total_chars, count(*) AS indexed_calls, 1::BIGINT AS unique_functions FROM ({R.PAGES})")
def _(spark, sf):
    return grep.grep_stats(page_corpus(spark, sf)).select("files", *BIG("total_lines", "total_chars", "indexed_calls", "unique_functions"))


@query("agg_14_index_stats", f"SELECT (SELECT count(DISTINCT term) FROM ({R.TF})) AS unique_terms, (SELECT count(*) FROM ({R.TF})) AS total_terms, (SELECT count(*) FROM documents) AS total_documents")
def _(spark, sf):
    docs = index.plain_feed(corpus(spark, sf))
    return index.index_stats(index.postings(docs), docs)


# --- walks over derived paths ----------------------------------------------------------

_DIRS = ("src", "docs", "test", "node_modules", "service")
_NAMES = ("Service.java", "README.md", "main.py", "pom.xml", "ServiceImpl.java", "util.c", "Makefile", "x.bin")


def _tree(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.get(F.array(*[F.lit(d) for d in _DIRS]), (c("p_partkey") % 5).cast("int")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/p"), c("p_partkey").cast("string"),
                    F.get(F.array(*[F.lit(n) for n in _NAMES]), (c("p_size") % 8).cast("int")))
    return p.select(path.alias("path"), F.concat("p_type", F.lit("\n"), "p_brand", F.lit("\n"), "p_name").alias("content"), F.lit("text").alias("language"), c("p_partkey").alias("ord"))


_T = f"SELECT {list(_DIRS)}[p_partkey % 5 + 1] || '/' || replace(p_name, ' ', '/') || '/p' || p_partkey || {list(_NAMES)}[p_size % 8 + 1] AS path, p_type || chr(10) || p_brand || chr(10) || p_name AS content, p_partkey AS ord FROM part"
_TE = f"SELECT *, lower(regexp_extract(path, '\\.[^./]*$')) AS ext FROM ({_T})"


@query("src_25_search_files", f"SELECT path, CASE WHEN contains(lower(path), 'ring') THEN 'ring' ELSE 'brand#2' END AS matched_term FROM ({_TE}) WHERE ext IN {R.sql_in(fixed.WALK_CODE_EXTENSIONS)} AND split_part(path, '/', 1) <> 'test' AND (contains(lower(path), 'ring') OR contains(lower(content), 'brand#2')) ORDER BY ord LIMIT 45")
def _(spark, sf):
    return filesrc.search_files(_tree(spark, sf), ["ring", "brand#2"], 45, exclude=("test",)).select("path", "matched_term")


@query("src_26_pattern_files", f"SELECT path, CASE WHEN ends_with(path, 'Service.java') THEN 'Service' ELSE 'ServiceImpl' END AS matched_term FROM ({_T}) WHERE ends_with(path, 'Service.java') OR ends_with(path, 'ServiceImpl.java') ORDER BY ord LIMIT 20")
def _(spark, sf):
    return filesrc.pattern_files(_tree(spark, sf)).select("path", "matched_term")


_LV = f"SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS parent, p[i] AS name, i < len(p) AS is_dir, i - 1 AS level FROM (SELECT string_split(path, '/') AS p, unnest([1, 2, 3]) AS i FROM ({_T}) WHERE NOT starts_with(path, 'node_modules'))"


@query("src_27_tree_listing", f"SELECT level, parent, name FROM ({_LV}) ORDER BY CASE WHEN parent = '' THEN name ELSE parent || '/' || name END LIMIT 50")
def _(spark, sf):
    return filesrc.tree(_tree(spark, sf)).select(*BIG("level"), "parent", "name")


@query("src_28_repo_structure", f"SELECT (SELECT count(*) FROM (SELECT DISTINCT array_to_string(p[1:i], '/') FROM (SELECT string_split(path, '/') AS p, unnest([1, 2, 3]) AS i FROM ({_T}) WHERE NOT starts_with(path, 'node_modules')))) AS directories, count(*) AS total_files, "
       f"count_if(regexp_extract(path, '[^/]*$') IN {R.sql_in(fixed.CONFIG_FILE_NAMES)})::BIGINT AS config_files, count_if(ext IN {R.sql_in(fixed.STRUCTURE_SOURCE_EXTENSIONS)})::BIGINT AS source_files FROM ({_TE}) WHERE NOT starts_with(path, 'node_modules')")
def _(spark, sf):
    return aggregates.repo_structure(_tree(spark, sf)).select("directories", "total_files", "config_files", "source_files")


@query("src_29_sample_sources", f"SELECT path, array_to_string(string_split(content, chr(10))[1:2], chr(10)) AS head FROM ({_TE}) WHERE ext IN {R.sql_in(fixed.STRUCTURE_SOURCE_EXTENSIONS)} ORDER BY ord LIMIT 10")
def _(spark, sf):
    return filesrc.sample_sources(_tree(spark, sf), 10, 2)


_CF = f"SELECT CASE WHEN ends_with(path, 'pom.xml') THEN regexp_extract(path, '^.*/') || 'pom.xml' ELSE path END AS path, content, ord FROM ({_T})"


@query("src_30_config_files", f"SELECT path, CASE WHEN length(content) > 20 THEN left(content, 20) || chr(10) || '... [truncated]' ELSE content END AS content FROM ({_CF}) WHERE ends_with(path, '/pom.xml') ORDER BY ord LIMIT 5")
def _(spark, sf):
    f = _tree(spark, sf).withColumn("path", F.regexp_replace("path", "/p[0-9]+pom\\.xml$", "/pom.xml"))
    return filesrc.config_files(f, most=20)


@query("src_32_attachments", f"SELECT path, md5(chr(10) || '### File: ' || regexp_extract(path, '[^/]*$') || chr(10) || '```' || chr(10) || left(content, 50000) || chr(10) || '```' || chr(10)) AS h FROM ({R.DOCS})")
def _(spark, sf):
    return filesrc.attachments(corpus(spark, sf)).select("path", F.md5("section").alias("h"))


@query("src_12_scan_cap", f"SELECT path FROM ({R.DOCS}) ORDER BY path LIMIT 10000")
def _(spark, sf):
    return filesrc.limited(corpus(spark, sf), 10_000).select("path")


# --- rendered text ------------------------------------------------------------------------

@query("ctx_03_symbol_text", f"SELECT key, '### ' || type || ': `' || name || '`' || chr(10) || 'Line: ' || line || ' | Relevance: ' || (ord % 90 + 1) || chr(10) || '```c' || chr(10) || 'int ' || name || '()' || chr(10) || '```' || chr(10) || chr(10) AS t FROM ({R.SYMBOLS})")
def _(spark, sf):
    s = symbols(spark, sf).withColumn("relevance_score", c("ord") % 90 + 1).withColumn("signature", F.concat(F.lit("int "), "name", F.lit("()"))).withColumn("summary", F.lit(None).cast("string"))
    return s.select("key", context.symbol_text().alias("t"))


@query("ctx_04_block_text", f"SELECT path, md5('### Code: ' || regexp_extract(path, '[^/]*$') || ':1 (' || language || ')' || chr(10) || '```text' || chr(10) || array_to_string(string_split(content, chr(10))[1:80], chr(10)) || chr(10) || '```' || chr(10) || chr(10)) AS t FROM ({R.DOCS})")
def _(spark, sf):
    b = corpus(spark, sf).select(c("path").alias("file"), F.lit(1).alias("start_line"), c("language").alias("symbol"), c("content").alias("code"))
    return b.select(c("file").alias("path"), F.md5(context.block_text()).alias("t"))


@query("ctx_05_final_context", "SELECT p_partkey, '# Code Analysis Context' || chr(10) || chr(10) || '**Query:** q' || chr(10) || '**Search Results:** ' || p_size || ' symbols, 2 code blocks' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# PRIMARY RESULTS (High Relevance)' || chr(10) || p_name || chr(10) || chr(10) AS t FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", context.final_context(c("p_name"), F.lit(" "), "q", c("p_size"), F.lit(2)).alias("t"))


@query("ctx_06_search_text", "SELECT '# Search Results for: \"small\"' || chr(10) || 'Intent: find, Target: \"small\"' || chr(10) || chr(10) || '## Relevant Symbols (' || (SELECT count(*) FROM part) || ' found)' || chr(10) || chr(10) || string_agg(s, '' ORDER BY m, o) AS context FROM "
       "(SELECT '### ' || regexp_extract(file, '[^/]*$') || chr(10) || 'Path: ' || file || chr(10) || chr(10) || string_agg('- **' || name || '** (' || type || ') line ' || line || chr(10), '' ORDER BY ms DESC, ord) FILTER (rn <= 5) || chr(10) AS s, min(-ms) AS m, min((-ms, ord)) AS o FROM "
       f"(SELECT *, row_number() OVER (PARTITION BY file ORDER BY ms DESC, ord) AS rn FROM (SELECT *, ord % 50 AS ms FROM ({R.SYMBOLS}) ORDER BY ms DESC, ord LIMIT 30)) GROUP BY file)")
def _(spark, sf):
    s = symbols(spark, sf).withColumn("match_score", c("ord") % 50).withColumn("summary", F.lit(None).cast("string"))
    return context.search_text(s, "small", "find", "small")


@query("ctx_09_hits_text", f"SELECT path, md5('### ' || path || chr(10) || chr(10) || string_agg('**Line ' || line || ':**' || chr(10) || '```txt' || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY line, col)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, col) AS rn FROM ({_literal_sql('anthe')})) WHERE rn <= 10 GROUP BY path")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "anthe", max_results=None, context_lines=0)
    return context.hits_text(h).select("path", F.md5("section").alias("h"))


@query("ctx_10_file_list", f"SELECT '- `' || path || '`' AS line FROM (SELECT path, min(ord) AS ord FROM ({_literal_sql('anthe')}) GROUP BY path ORDER BY ord LIMIT 10)")
def _(spark, sf):
    return context.file_list(grep.search_literal(corpus(spark, sf), "anthe", max_results=None)).select("line")


@query("ctx_11_workspace_context", f"SELECT path, score, lines_used FROM (SELECT *, coalesce(sum(lines_used) OVER (ORDER BY score DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT path, ord, (10 + 10 - 15 + CASE WHEN contains(path, 'src1/') THEN 10 ELSE 0 END)::BIGINT AS score, "
       f"least(len(string_split(content, chr(10))), 40) AS lines_used FROM ({R.DOCS}) ORDER BY score DESC, ord LIMIT 15)) WHERE before < 100")
def _(spark, sf):
    return context.workspace_context(corpus(spark, sf), ["src1/"], per_file=40, total=100).select("path", *BIG("score", "lines_used"))


@query("ctx_13_combined_content", "SELECT p_partkey, p_name || chr(10) || chr(10) || '## Reference Code from Workspace' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) AS t FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", context.combined_content(c("p_name"), F.lit(""), c("p_brand"), F.lit(None).cast("string")).alias("t"))


@query("str_39_snippets", f"SELECT h.path, line, col AS \"column\", md5(trim(array_to_string(ls[greatest(line - 2, 1):line + 2], chr(10)), ' ' || chr(10))) AS s FROM ({_literal_sql('anthe')}) h JOIN (SELECT path, string_split(content, chr(10)) AS ls FROM ({R.DOCS})) d ON h.path = d.path")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "anthe", max_results=None)
    return h.select("path", *BIG("line", "column"), F.md5(context.snippet()).alias("s"))


@query("str_40_split_chunks", """WITH RECURSIVE l AS (SELECT doc_id, length(t) AS n, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 f(doc_id, i, part, cur) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents UNION ALL SELECT f.doc_id, l.i, part + (cur > 0 AND cur + n > 2000)::BIGINT, CASE WHEN cur > 0 AND cur + n > 2000 THEN 0 ELSE cur END + n + 1
 FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1) SELECT doc_id, part, max(cur) AS n FROM f WHERE i > 0 GROUP BY ALL""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(text.split_at_lines(F.split("text", "\n", -1), 2000)).alias("part", "chunk"))
    return d.select("doc_id", *BIG("part"), F.length("chunk").cast("bigint").alias("n"))


@query("str_40_chunks_keep_text", "SELECT doc_id, length(text) + 1 AS n FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.split_at_lines(F.split("text", "\n", -1), 2000)).alias("chunk"))
    return d.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("n"))


@query("top_13_truncate")
def _(spark, sf):
    return topk.truncated(table(spark, sf, "documents").select("doc_id", "text"), "text", 1500).select("doc_id", F.length("text").alias("n"))


@query("udf_01_completion", "SELECT item_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 70) || chr(10) || chr(10) || '[Additional context truncated]' END AS answer FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    return models.with_completion(b, "text", "answer", models.with_fallback(models.stand_in(120))).select("item_id", "answer")


@query("rnk_22_model_rerank", "SELECT p_partkey, 101 - list_position([5, 3, 9], p_partkey) AS score FROM part WHERE p_partkey IN (5, 3, 9)")
def _(spark, sf):
    f = table(spark, sf, "part").select("p_partkey", c("p_partkey").alias("file_no"), F.lit("grep").alias("source"))
    return models.rerank(f, [5, 3, 9, 3]).select("p_partkey", *BIG("score"))


@query("top_11_pack_whole_table", "WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY p_retailprice % 7, p_partkey) AS i, p_partkey, p_size FROM part), "
       "r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, -1::BIGINT AS k UNION ALL SELECT s.i, CASE WHEN used + p_size < 60 THEN used + p_size ELSE used END, CASE WHEN used + p_size < 60 THEN p_partkey ELSE -1 END FROM r JOIN s ON s.i = r.i + 1) SELECT k AS p_partkey FROM r WHERE k >= 0")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", c("p_size").alias("size"), (c("p_retailprice") % 7).alias("o"))
    return topk.pack(p, 60, ("o", "p_partkey")).select("p_partkey")


@query("top_11_greedy_packing", "WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) AS i, p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 100)), "
       "r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, -1::BIGINT AS k UNION ALL SELECT s.i, CASE WHEN used + p_size < 777 THEN used + p_size ELSE used END, CASE WHEN used + p_size < 777 THEN p_partkey ELSE -1 END FROM r JOIN s ON s.i = r.i + 1) SELECT k AS p_partkey FROM r WHERE k >= 0")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", c("p_size").alias("size"))
    return topk.pack(p, 777, (F.desc("size"), "p_partkey"), limit=100).select("p_partkey")


@query("src_09_corpus_lines", f"SELECT path, count(*) AS lines, max(length(text)) AS longest FROM ({R.LINES}) GROUP BY path")
def _(spark, sf):
    return grep.corpus_lines(corpus(spark, sf)).groupBy("path").agg(F.count("*").alias("lines"), F.max(F.length("text")).cast("bigint").alias("longest"))
