"""Literal, regex, call-site and ranked search over documents, pages and parts."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import context, grep, index, joins, rank, topk
from ..plans import models, scope, search
from . import registry as R
from .registry import corpus, joined, page_corpus, query, symbols, table

c = F.col
BIG = lambda *names: [c(n).cast("bigint").alias(n) for n in names]


def _literal_sql(pattern, word=False, order=False, limit=None, extra="", src=R.LINES, case=False):
    p, n = pattern if case else pattern.lower(), len(pattern)
    t = "text" if case else "lower(text)"
    sql = (f"SELECT path, ord, line, i AS col, text FROM (SELECT ord, path, line, text, unnest(list_filter(range(1, length(text) - {n} + 2), lambda i: substring({t}, i, {n}) = '{p}')) AS i "
           f"FROM ({src}) WHERE contains({t}, '{p}'))")
    if word:
        sql += f" WHERE NOT (i > 1 AND regexp_matches(substring(text, i - 1, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substring(text, i + {n}, 1), '[A-Za-z0-9_]')"
    if limit:
        sql += f" ORDER BY ord, line, col LIMIT {limit}"
    return sql


@query("grp_01_literal_search", f"SELECT path, line, col AS \"column\", text AS match_line, substring(text, col, 6) AS match_text FROM ({_literal_sql('edtion', limit=None)})")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "edtion", max_results=None)
    return h.select("path", *BIG("line", "column"), "match_line", "match_text")


@query("grp_01_overlapping", f"SELECT path, line, col AS \"column\" FROM ({_literal_sql('haha')})")
def _(spark, sf):
    return grep.search_literal(corpus(spark, sf), "haha", max_results=None).select("path", *BIG("line", "column"))


@query("grp_01_top_200_with_context", "SELECT h.path, line, col AS \"column\", array_to_string(ls[greatest(line - 2, 1):line - 1], '~') AS before, array_to_string(ls[line + 1:line + 2], '~') AS after "
       f"FROM ({_literal_sql('tion', limit=200)}) h JOIN (SELECT path, string_split(content, chr(10)) AS ls FROM ({R.DOCS})) d ON h.path = d.path")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "TION", max_results=200)
    return h.select("path", *BIG("line", "column"), joined("before", "~").alias("before"), joined("after", "~").alias("after"))


@query("grp_01_whole_word", f"SELECT path, line, col AS \"column\" FROM ({_literal_sql('the', word=True)})")
def _(spark, sf):
    return grep.search_literal(corpus(spark, sf), "the", whole_word=True, max_results=None).select("path", *BIG("line", "column"))


@query("grp_01_case_sensitive_in_files", f"SELECT path, line, col AS \"column\" FROM ({_literal_sql('The', case=True)}) WHERE contains(path, 'src1/')")
def _(spark, sf):
    return grep.search_literal(corpus(spark, sf), "The", case_sensitive=True, file_pattern="SRC1/", max_results=None).select("path", *BIG("line", "column"))


@query("grp_02_regex_search", "SELECT path, line, m AS match_text, substring(m, 5, 3) AS g1 FROM (SELECT path, line, unnest(regexp_extract_all(text, '\\+1 \\(\\d{3}\\) \\d{3}-\\d{4}')) AS m "
       f"FROM ({R.LINES})) WHERE true")
def _(spark, sf):
    h = grep.search_regex(corpus(spark, sf), r"\+1 \((\d{3})\) \d{3}-\d{4}", groups=1, max_results=None)
    return h.select("path", *BIG("line"), "match_text", F.get("groups", F.lit(0)).alias("g1"))


@query("grp_02_backreference", f"SELECT path, len(regexp_extract_all(content, '{'|'.join(x + x for x in 'abcdefghijklmnopqrstuvwxyz')}')) AS n FROM ({R.DOCS}) WHERE n > 0")
def _(spark, sf):
    return grep.search_regex(corpus(spark, sf), r"([a-z])\1", groups=1, flags="").groupBy("path").agg(F.count("*").alias("n"))


@query("grp_02_zero_width", f"SELECT path, line FROM ({R.LINES})")
def _(spark, sf):
    return grep.search_regex(corpus(spark, sf), "^", flags="md").select("path", *BIG("line"))


_SIX = r"\+(1) \((\d)(\d)(\d)\) (\d{3})-(\d{4})"


@query("grp_02_many_groups", "SELECT path, line, array_to_string([" + ", ".join(f"regexp_extract(m, '{_SIX}', {i})" for i in range(1, 7)) + f"], '|') AS groups FROM (SELECT path, line, unnest(regexp_extract_all(text, '{_SIX}')) AS m FROM ({R.LINES}))")
def _(spark, sf):
    return grep.search_regex(corpus(spark, sf), _SIX, groups=6).select("path", *BIG("line"), R.joined("groups").alias("groups"))


_PLINES = f"SELECT ord, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM ({R.PAGES})"
_CALLS = ("SELECT fn, path, ord, line, rule FROM (SELECT path, ord, line, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([a-zA-Z_]\\w*)\\s*\\(', 1)) AS fn, 0 AS rule FROM ({lines}) UNION ALL "
          "SELECT path, ord, line, unnest(regexp_extract_all(text, '\\.([a-zA-Z_]\\w*)\\s*\\(', 1)), 1 FROM ({lines}) UNION ALL SELECT path, ord, line, unnest(regexp_extract_all(text, '->([a-zA-Z_]\\w*)\\s*\\(', 1)), 2 FROM ({lines}) "
          "UNION ALL SELECT path, ord, line, unnest(regexp_extract_all(text, '::([a-zA-Z_]\\w*)\\s*\\(', 1)), 3 FROM ({lines})) WHERE length(fn) >= 2 AND fn NOT IN " + R.sql_in(fixed.CALL_INDEX_KEYWORDS))
PCALLS = _CALLS.replace("{lines}", _PLINES)


@query("grp_03_call_index", f"SELECT fn, path, line, rule, count(*) AS n FROM ({PCALLS}) GROUP BY ALL")
def _(spark, sf):
    return grep.call_sites(page_corpus(spark, sf)).groupBy("fn", "path", c("line").cast("bigint").alias("line"), c("rule").cast("bigint").alias("rule")).agg(F.count("*").alias("n"))


@query("grp_04_call_sites_of", "SELECT path, count(*) AS n, min(line) AS line FROM (SELECT path, line, unnest(regexp_extract_all(text, 'track\\(')) AS m FROM (" + _PLINES + ")) GROUP BY path")
def _(spark, sf):
    h = grep.search_calls(page_corpus(spark, sf), "track", max_results=None)
    return h.groupBy("path").agg(F.count("*").alias("n"), F.min("line").cast("bigint").alias("line"))


@query("grp_05_symbol_usages", "SELECT path, line, CASE WHEN regexp_matches(text, 'track\\(') THEN 'call' ELSE 'reference' END AS usage_type FROM (" + _PLINES + ") WHERE regexp_matches(text, '(^|\\W)track(\\W|$)') ORDER BY usage_type, ord, line LIMIT 200")
def _(spark, sf):
    return grep.symbol_usages(page_corpus(spark, sf), "track", max_results=200).select("path", *BIG("line"), "usage_type")


@query("grp_06_with_function_context", "SELECT h.path, h.line, arg_max(d.name, d.line) AS enclosing FROM (" + _literal_sql("555-", src=R.LINES) + ") h LEFT JOIN "
       "(SELECT path, line, coalesce(nullif(regexp_extract(text, '^\\s*(?:static\\s+)?(?:inline\\s+)?(\\w+(?:\\s*\\*)*)\\s+(\\w+)\\s*\\([^)]*\\)\\s*\\{?\\s*$', 2), ''), nullif(regexp_extract(text, '^\\s*def\\s+(\\w+)\\s*\\(', 1), ''), "
       "nullif(regexp_extract(text, '^\\s*(?:async\\s+)?function\\s+(\\w+)\\s*\\(', 1), ''), nullif(regexp_extract(text, '^\\s*(?:public|private|protected)?\\s*(?:static\\s+)?(\\w+)\\s+(\\w+)\\s*\\(', 2), '')) AS name "
       f"FROM ({R.LINES})) d ON h.path = d.path AND d.name IS NOT NULL AND d.line <= h.line AND d.line > h.line - 100 GROUP BY h.path, h.line, h.col")
def _(spark, sf):
    h = grep.search_with_function(corpus(spark, sf), "555-", max_results=None)
    return h.select("path", *BIG("line"), c("enclosing_name").alias("enclosing"))


@query("grp_07_most_called", f"SELECT fn, count(*) AS call_count FROM ({PCALLS}) GROUP BY fn ORDER BY call_count DESC, min(ord) LIMIT 50")
def _(spark, sf):
    return grep.most_called(grep.call_sites(page_corpus(spark, sf)))


@query("grp_08_call_counts", f"SELECT fn, count(*) AS sites, count(DISTINCT path) AS files FROM ({PCALLS}) GROUP BY fn")
def _(spark, sf):
    return grep.call_sites(page_corpus(spark, sf)).groupBy("fn", "path").agg(F.count("*").alias("n")).groupBy("fn").agg(F.sum("n").alias("sites"), F.count("*").alias("files"))


def _leg(words, per, limit_legs=True):
    return " UNION ALL ".join(f"(SELECT {i} AS leg, path, ord, line, col FROM ({_literal_sql(w, limit=per)}))" for i, w in enumerate(words))


def _dedupe(legs, limit):
    return f"SELECT path, line FROM (SELECT path, line, min((leg, ord, line, col)) AS o FROM ({legs}) GROUP BY 1, 2) ORDER BY o LIMIT {limit}"


@query("grp_10_keyword_search", _dedupe(_leg(["ering", "anthe", "ouxou"], 40), 30))
def _(spark, sf):
    return grep.keyword_search(corpus(spark, sf), ["ering", "anthe", "ouxou"], 40, 30).select("path", *BIG("line"))


@query("grp_11_any_term_lines", f"SELECT path, line, text FROM ({R.LINES}) WHERE contains(lower(text), 'ering') AND true OR contains(lower(text), 'zzz') ORDER BY ord, line LIMIT 50")
def _(spark, sf):
    return grep.any_term_lines(grep.corpus_lines(corpus(spark, sf)), ["ering", "zzz"], 50).select("path", c("line").cast("bigint").alias("line"), "text")


@query("grp_12_find_three_per_file", f"SELECT path, line, rn FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY o) AS rn FROM (SELECT path, line, min((leg, ord, line, col)) AS o FROM ({_leg(['ering', 'anthe'], 30)}) GROUP BY 1, 2 ORDER BY o LIMIT 50)) WHERE rn <= 3")
def _(spark, sf):
    from ..operators import ordering
    found = grep.keyword_search(corpus(spark, sf), ["ering", "anthe"], 30, 50)
    return ordering.top_per_key(found, ["path"], ["leg", "ord", "line"], 3).select("path", *BIG("line", "rn"))


@query("grp_14_trigram_file_search", f"SELECT path, count(*) AS match_count FROM ({R.LINES}) WHERE contains(lower(text), 'ations') GROUP BY path, ord ORDER BY match_count DESC, ord LIMIT 100")
def _(spark, sf):
    return rank.trigram_file_search(corpus(spark, sf), "ations").select("path", *BIG("match_count"))


_POSTED = f"SELECT path, count(*) AS match_count, md5(string_agg(line || ':' || trim(text), chr(10) ORDER BY line)) AS h FROM ({R.LINES}) WHERE contains(lower(text), 'er the') GROUP BY path, ord"


def _grams(spark, sf):
    """Positional postings of the documents, stored by gram."""
    from ..operators import ordering
    return ordering.stored(index.positioned_trigrams(corpus(spark, sf)), "tri", ranges=False)


@query("grp_14_by_postings", _POSTED)
def _(spark, sf):
    found = rank.trigram_file_search(corpus(spark, sf), "er the", max_results=10_000_000, posts=_grams(spark, sf))
    said = F.array_join(F.transform("matches", lambda m: F.concat(m["line"].cast("string"), F.lit(":"), m["context"])), "\n")
    return found.select("path", *BIG("match_count"), F.md5(said.cast("binary")).alias("h"))


@query("grp_15_by_postings", f"SELECT path, line, trim(text) AS context FROM ({R.LINES}) WHERE contains(lower(text), 'ering an')")
def _(spark, sf):
    return rank.lines_by_postings(corpus(spark, sf), _grams(spark, sf), "ERing an").select("path", *BIG("line"), "context")


@query("idx_15_literal_offsets", f"SELECT term, path, length(content) - length(replace(lower(content), term, substr(term, 2))) AS n FROM ({R.DOCS}), (SELECT unnest(['ering an', 'the on']) AS term) WHERE contains(lower(content), term)")
def _(spark, sf):
    terms = spark.createDataFrame([("ering an",), ("the on",), ("zz  zz",)], "term string")
    return rank.literal_offsets(_grams(spark, sf), terms).select("term", "path", F.size("offsets").cast("bigint").alias("n"))


@query("grp_15_text_in_code", f"SELECT path, line, trim(text) AS context FROM ({R.LINES}) WHERE length(text) >= 3 AND contains(lower(text), 'er the')")
def _(spark, sf):
    return rank.find_text_in_code(grep.corpus_lines(corpus(spark, sf)), "ER the").select("path", *BIG("line"), "context")


@query("grp_09_topic_search", f"""SELECT path, line, score FROM (SELECT path, ord, line, CASE WHEN contains(t, 'edtion the') THEN 0 WHEN contains(t, 'edtion') THEN 1 ELSE 2 END AS leg,
 CASE WHEN contains(t, 'edtion the') THEN 10 ELSE 0 END + CASE WHEN contains(t, 'edtion') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'the') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)^\\s*(PROC|SUBPROC)\\s+\\w+') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i)^\\s*(public|private|protected)\\s+') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)^\\s*(class|interface|function|def)\\s+') THEN 15 ELSE 0 END AS score
 FROM (SELECT *, lower(text) AS t FROM ({R.LINES})) WHERE contains(t, 'edtion') OR contains(t, 'the')) ORDER BY score DESC, leg, ord, line LIMIT 100""")
def _(spark, sf):
    return search.topic_search(corpus(spark, sf), "edtion the").select("path", *BIG("line", "score"))


@query("grp_13_planned_search", "SELECT path, count(*) AS n FROM (SELECT path, line FROM (SELECT ord, path, line FROM (" + PCALLS + ") WHERE fn = 'track' ORDER BY ord LIMIT 100) GROUP BY 1, 2) GROUP BY 1 ORDER BY path")
def _(spark, sf):
    return search.planned_search(page_corpus(spark, sf), "who calls track", 100).groupBy("path").agg(F.count("*").alias("n"))


# --- TF-IDF ------------------------------------------------------------------------------

def _tfidf_sql(words, limit=50, min_score=0.1):
    return (f"WITH h AS (SELECT path, term, tf FROM ({R.TF}) WHERE term IN {R.sql_in(words)}), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), "
            f"s AS (SELECT path, sum(ln(1 + tf) * ln((SELECT count(*) FROM documents) / (1 + df)) * (1 + ln(2.0) * 0.1)) AS total, count(*) AS matched FROM h JOIN d USING (term) GROUP BY 1) "
            f"SELECT path, round(total * (1 + matched / {len(words)}), 6) AS score, matched FROM s WHERE total >= {min_score} ORDER BY total * (1 + matched / {len(words)}) DESC, path LIMIT {limit}")


@query("rnk_01_tfidf_search", _tfidf_sql(["anthe", "thering", "anti"]))
def _(spark, sf):
    r = rank.search_documents(index.plain_feed(corpus(spark, sf)), "anthe thering anti")
    return r.select(c("doc_id").alias("path"), F.round("score", 6).alias("score"), "matched")


@query("rnk_01_tfidf_stemmed_query", _tfidf_sql(["est", "ouxou", "hear"]))
def _(spark, sf):
    r = rank.search_documents(index.plain_feed(corpus(spark, sf)), "ested ouxou hearing", stem_query=True)
    return r.select(c("doc_id").alias("path"), F.round("score", 6).alias("score"), "matched")


@query("rnk_02_posting_scores", f"SELECT path, term, round(ln(1 + tf) * ln((SELECT count(*) FROM documents) / (1 + count(*) OVER (PARTITION BY term))), 6) AS w FROM ({R.TF}) WHERE term IN ('the', 'onthe', 'of')")
def _(spark, sf):
    docs = index.plain_feed(corpus(spark, sf))
    hits = index.postings(docs, only=["the", "onthe", "of"])
    df = hits.groupBy("term").agg(F.count_if(c("tf") > 0).alias("df"))  # reads tf as the other side does, so texts are cut once
    n = docs.agg(F.count("*")).scalar()
    return hits.join(F.broadcast(df), "term").select(c("doc_id").alias("path"), "term", F.round(rank.tfidf(c("freq"), n, c("df")), 6).alias("w"))


_MIX = f"""SELECT path AS doc_id, 'file' AS doc_type, content FROM ({R.DOCS}) UNION ALL SELECT 'bench:' || item_id, 'summary', text FROM benchmark"""


def _typed_sql(kind):
    return (f"WITH t AS (SELECT doc_id, doc_type, term, count(*) * CASE doc_type WHEN 'summary' THEN 3.0 ELSE 1.0 END AS f FROM (SELECT doc_id, doc_type, {R.stem('w')} AS term FROM (SELECT doc_id, doc_type, unnest({R.index_tokens('content')}) AS w FROM ({_MIX})) "
            "WHERE length(w) > 1 AND w NOT IN ('the', 'an')) WHERE term IN ('onth', 'ering') GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), "
            f"s AS (SELECT doc_id, sum(ln(1 + f) * ln((SELECT count(*) FROM ({_MIX})) / (1 + df)) * (1 + ln(2.0) * 0.1)) AS total, count(*) AS matched FROM t JOIN d USING (term) WHERE doc_type = '{kind}' GROUP BY 1) "
            "SELECT doc_id, round(total * (1 + matched / 2), 6) AS score FROM s WHERE total >= 0.1 ORDER BY total * (1 + matched / 2) DESC, doc_id LIMIT 50")


@query("rnk_03_typed_search", _typed_sql("summary"))
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("bench:"), "item_id").alias("doc_id"), F.lit("summary").alias("doc_type"), c("text").alias("content"))
    docs = corpus(spark, sf).select(c("path").alias("doc_id"), F.lit("file").alias("doc_type"), "content").unionByName(b)
    return rank.search_documents(docs, "onth ering", doc_types=["summary"]).select("doc_id", F.round("score", 6).alias("score"))


# --- vectors --------------------------------------------------------------------------------

_COS = "list_cosine_similarity(e.embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0))"


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").scalar()


@query("rnk_04_vector_search", f"SELECT vec_id, round({_COS}::DOUBLE, 4) AS similarity FROM embeddings e WHERE {_COS} >= 0.3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return rank.nearest_vectors(e, _query_vector(spark, sf), tie="vec_id").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("rnk_05_cosine", f"SELECT vec_id, round({_COS}::DOUBLE, 4) AS similarity, 0.0::DOUBLE AS bad FROM embeddings e")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.withColumn("q", _query_vector(spark, sf))
    return e.select("vec_id", F.round(rank.cosine(c("embedding"), c("q")), 4).alias("similarity"), rank.cosine(c("embedding"), F.array(F.lit(0.5))).alias("bad"))


_TOP = f"SELECT label, vec_id, {_COS}::DOUBLE AS sim FROM embeddings e WHERE {_COS} > 0.1 ORDER BY sim DESC, vec_id LIMIT 100"


@query("rnk_18_files_by_vectors", f"SELECT label::VARCHAR AS file, floor(max(sim) * 100 + 0.5)::BIGINT + least(count(*) * 2, 20) AS score, count(*) AS match_count FROM ({_TOP}) GROUP BY 1")
def _(spark, sf):
    near = rank.nearest_vectors(table(spark, sf, "embeddings"), _query_vector(spark, sf), 100, 0.1, tie="vec_id")
    return rank.files_by_vectors(near.select(c("label").cast("string").alias("file"), "similarity")).select("file", *BIG("score"), "match_count")


@query("joi_14_query_by_corpus", f"SELECT label, round(max({_COS})::DOUBLE, 4) AS best, count(*) AS n FROM embeddings e GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("q", _query_vector(spark, sf)).withColumn("s", rank.cosine(c("embedding"), c("q")))
    return e.groupBy(c("label").cast("bigint").alias("label")).agg(F.round(F.max("s"), 4).alias("best"), F.count("*").alias("n"))


@query("rnk_19_files_by_index", f"SELECT split_part(path, '/', 1) AS file, least(floor(max(sc) * 20 + 0.5), 100)::BIGINT + least(count(*) * 3, 30) AS score, count(*) AS match_count FROM "
       f"(SELECT path, score AS sc FROM ({_tfidf_sql(['anthe', 'thering', 'anti'], 200)})) GROUP BY 1 ORDER BY score DESC, file LIMIT 40")
def _(spark, sf):
    found = rank.search_documents(index.plain_feed(corpus(spark, sf)), "anthe thering anti", max_results=200)
    return rank.files_by_index(found.select(F.substring_index("doc_id", "/", 1).alias("file"), F.round("score", 6).alias("score"))).select("file", *BIG("score"), "match_count")


# --- symbols and files -------------------------------------------------------------------------------

@query("rnk_08_symbols_by_pattern", f"SELECT key, CASE WHEN name = 'red_' THEN 100 WHEN starts_with(name, 'red_') THEN 90 WHEN contains(name, 'red_') THEN 70 END::BIGINT AS score FROM ({R.SYMBOLS}) WHERE contains(replace(name, '_', ''), 'red') AND contains(name, 'red_') ORDER BY score DESC, ord LIMIT 50")
def _(spark, sf):
    return rank.symbols_by_pattern(symbols(spark, sf), "Red_").select("key", c("match_score").cast("bigint").alias("score"))


@query("rnk_08_symbols_by_postings", f"SELECT key, CASE WHEN starts_with(name, 'red_') THEN 90 ELSE 70 END::BIGINT AS score FROM ({R.SYMBOLS}) WHERE contains(name, 'red_') ORDER BY score DESC, ord LIMIT 50")
def _(spark, sf):
    s = symbols(spark, sf)
    return rank.symbols_by_trigram_postings(s, index.symbol_trigrams(s), "red_").select("key", c("match_score").cast("bigint").alias("score"))


@query("rnk_09_pattern_fallback", f"SELECT key, 50::BIGINT AS score FROM ({R.SYMBOLS}) WHERE contains(name, 'd_') ORDER BY ord LIMIT 50")
def _(spark, sf):
    return rank.symbols_by_pattern(symbols(spark, sf), "D_").select("key", c("match_score").cast("bigint").alias("score"))


@query("rnk_12_fuzzy_symbols", "SELECT name, round(s, 6) AS score FROM (SELECT name, min(ord) AS ord, CASE WHEN name = 'smallring' THEN 100 WHEN contains(name, 'smallring') THEN 95 WHEN regexp_matches(name, 's.*m.*a.*l.*l.*r.*i.*n.*g') THEN 60 + 9 / length(name) * 20 "
       "WHEN 1 - levenshtein('smallring', name) / greatest(9, length(name)) > 0.5 THEN (1 - levenshtein('smallring', name) / greatest(9, length(name))) * 50 ELSE 0 END AS s "
       f"FROM ({R.SYMBOLS}) GROUP BY name) WHERE s >= 20")
def _(spark, sf):
    return rank.fuzzy_symbols(symbols(spark, sf), "SmallRing").select("name", F.round("match_score", 6).alias("score"))


@query("rnk_16_direct_symbols", f"SELECT key FROM ({R.SYMBOLS}) WHERE contains(name, 'gear') OR contains(file, 'gear') OR contains('find the gearbox', name) OR (length(name) > 4 AND contains('find the gearbox', left(name, 4))) ORDER BY ord LIMIT 50")
def _(spark, sf):
    return search.direct_symbols(symbols(spark, sf), "find the gearbox", ["gear"]).select("key")


def _part_files(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lower("p_type"), F.lit("/"), F.substring_index("p_name", " ", 1), F.lit("/"), F.substring_index("p_name", " ", -1), F.when(c("p_size") > 25, F.lit("s")).otherwise(F.lit("")),
                             F.when(c("p_partkey") % 3 == 0, F.lit("")).otherwise((c("p_partkey")).cast("string")), F.lit(".c")).alias("path"), c("p_partkey").alias("ord"))


_PF = ("SELECT lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || CASE WHEN p_size > 25 THEN 's' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END || '.c' AS path, "
       "p_partkey AS ord FROM part")


@query("rnk_07_concept_files", f"SELECT path, ord, score FROM (SELECT path, ord, CASE WHEN b IN ('rings', 'ring') OR b = 'ringss' THEN 100 WHEN starts_with(b, 'rings') AND length(b) < 13 THEN 90 WHEN starts_with(b, 'ring') AND length(b) < 12 THEN 90 ELSE 0 END::BIGINT AS score "
       f"FROM (SELECT path, ord, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '') AS b FROM ({_PF}))) WHERE score > 0")
def _(spark, sf):
    return rank.concept_files(_part_files(spark, sf), ["rings"]).select("path", "ord", c("match_score").cast("bigint").alias("score"))


@query("rnk_20_keyword_files", f"SELECT path, score FROM (SELECT path, ord, (CASE WHEN b = 'ring' THEN 100 WHEN starts_with(b, 'ring') THEN 60 WHEN contains(b, 'ring') THEN 25 ELSE 0 END + CASE WHEN contains(path, '/red/') THEN 15 ELSE 0 END)::BIGINT AS score "
       f"FROM (SELECT path, ord, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '') AS b FROM ({_PF}))) WHERE score > 0 ORDER BY score DESC, ord LIMIT 40")
def _(spark, sf):
    return rank.keyword_files(_part_files(spark, sf), None, ["ring", "red"]).select("path", *BIG("score"))


@query("joi_07_directory_match", f"SELECT dir, count(*) AS files FROM (SELECT array_to_string(p[1:i], '/') AS dir FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM ({_PF}))) "
       "WHERE contains(regexp_extract(dir, '[^/]*$'), 'hot') OR contains('hotel', regexp_extract(dir, '[^/]*$')) OR contains('hot', regexp_extract(dir, '[^/]*$')) GROUP BY dir")
def _(spark, sf):
    d = joins.directory_matches(index.directories(_part_files(spark, sf)), ["hot", "hotel"])
    return d.groupBy("dir").agg(F.count("*").alias("files"))


@query("joi_08_path_keywords", f"SELECT path, CASE WHEN contains(path, 'ring') THEN 'Ring' ELSE 'BOLT' END AS matched FROM ({_PF}) WHERE contains(path, 'ring') OR contains(path, 'bolt')")
def _(spark, sf):
    return joins.paths_with_any(_part_files(spark, sf), ["Ring", "BOLT"]).select("path", "matched")


@query("joi_12_siblings", f"WITH f AS (SELECT path, p[1] AS grand, p[2] AS parent FROM (SELECT path, string_split(path, '/') AS p FROM ({_PF}))), m AS (SELECT DISTINCT grand, parent FROM f WHERE starts_with(parent, 'red') OR ends_with(parent, 'red')) "
       "SELECT path, 40::BIGINT AS score FROM f WHERE grand IN (SELECT grand FROM m) AND (grand, parent) NOT IN (SELECT (grand, parent) FROM m) AND NOT contains(path, 'bolt')")
def _(spark, sf):
    f = _part_files(spark, sf)
    return joins.siblings(f, f.filter(F.contains("path", F.lit("bolt"))), ["red"]).select("path", *BIG("score"))


@query("rnk_23_relevance", "SELECT key, CASE WHEN nm OR fm THEN s ELSE greatest(s * 0.3, 10) END::DOUBLE AS score FROM (SELECT key, contains(name, 'ring') AS nm, false AS fm, "
       "least(ord % 50, 30)::DOUBLE + CASE WHEN name = 'ring' THEN 80 WHEN contains(name, 'ring') THEN (CASE WHEN regexp_matches(name, '(^|_)ring(_|$)') THEN 60 ELSE 35 END) ELSE 0 END + CASE WHEN type IN ('struct', 'class') THEN 15 ELSE 0 END AS s "
       f"FROM ({R.SYMBOLS}))")
def _(spark, sf):
    s = symbols(spark, sf).withColumn("match_score", c("ord") % 50).withColumn("summary", F.lit("")).withColumn("signature", F.lit(""))
    return s.select("key", rank.relevance(["ring"]).alias("score"))


def _found(spark, sf):
    return symbols(spark, sf).withColumn("match_score", c("ord") % 50).withColumn("match_source", F.concat(F.lit("leg"), (c("ord") % 3).cast("string")))


_FOUND = f"SELECT *, ord % 50 AS match_score, 'leg' || ord % 3 AS match_source FROM ({R.SYMBOLS})"


@query("agg_04_results_by_file", f"SELECT file, count(*) AS symbol_count, sum(match_score)::BIGINT AS total_match_score, array_to_string(list_sort(list(DISTINCT match_source)), '|') AS sources FROM ({_FOUND}) GROUP BY file")
def _(spark, sf):
    return rank.group_by_file(_found(spark, sf)).withColumn("sources", joined("sources"))


_SCORED = (f"WITH g AS (SELECT file, count(*) AS n, count(DISTINCT match_source) AS src FROM ({_FOUND}) GROUP BY file), "
           f"t AS (SELECT file, count_if(contains(name, 'ring')) AS a, count_if(contains(name, 'small')) AS b FROM ({_FOUND}) GROUP BY file), "
           "s AS (SELECT file, n, floor((a * 20 + b * 20) * CASE WHEN a > 0 AND b > 0 THEN 1.3 ELSE 0.7 END + src * 10 + 0.5)::BIGINT AS score FROM g JOIN t USING (file)) ")


@query("rnk_24_file_heuristic", _SCORED + "SELECT file, score, n AS symbol_count FROM s")
def _(spark, sf):
    return rank.score_files(_found(spark, sf), ["ring", "small"]).select("file", *BIG("score"), "symbol_count")


@query("rnk_25_files_by_heuristic", _SCORED + "SELECT file, score FROM s ORDER BY score DESC, file LIMIT 5")
def _(spark, sf):
    from ..operators import ordering
    return ordering.top(rank.score_files(_found(spark, sf), ["ring", "small"]), (F.desc("score"), "file"), 5).select("file", *BIG("score"))


_APPLIED = _SCORED + f"SELECT key, ord, coalesce(score, 50) AS file_score, coalesce(score, 50) + CASE WHEN contains(name, 'ring') THEN 30 ELSE 0 END + CASE WHEN contains(name, 'small') THEN 30 ELSE 0 END + CASE WHEN type IN ('struct', 'class') THEN 15 ELSE 0 END AS relevance_score FROM ({_FOUND}) f LEFT JOIN (SELECT * FROM s WHERE contains(file, 'promo')) s USING (file)"


def _applied(spark, sf):
    f = _found(spark, sf)
    scored = rank.score_files(f, ["ring", "small"]).filter(F.contains("file", F.lit("promo")))
    return rank.apply_file_scores(f, scored, ["ring", "small"])


@query("rnk_27_symbol_relevance", f"SELECT key, file_score, relevance_score::BIGINT AS relevance_score FROM ({_APPLIED})")
def _(spark, sf):
    return _applied(spark, sf).select("key", *BIG("file_score", "relevance_score"))


@query("joi_02_file_score_join", f"SELECT file_score, count(*) AS n FROM ({_APPLIED}) GROUP BY 1")
def _(spark, sf):
    return _applied(spark, sf).groupBy(c("file_score").cast("bigint").alias("file_score")).agg(F.count("*").alias("n"))


@query("top_09_tiers", f"SELECT key, CASE WHEN relevance_score >= 70 OR rn <= 25 THEN 'primary' ELSE 'secondary' END AS tier FROM (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, ord) AS rn FROM ({_APPLIED})) WHERE relevance_score >= 40 OR rn <= 25")
def _(spark, sf):
    return rank.split_tiers(_applied(spark, sf)).select("key", "tier")


@query("ctx_02_secondary_context", "SELECT string_agg(type || ': ' || name || ' @ ' || regexp_extract(file, '[^/]*$') || ':' || line || chr(10), chr(10) || '---' || chr(10) ORDER BY relevance_score DESC, ord) AS context FROM "
       f"(SELECT a.relevance_score, f.* FROM ({_APPLIED}) a JOIN ({R.SYMBOLS}) f USING (key) ORDER BY a.relevance_score DESC, f.ord LIMIT 100)")
def _(spark, sf):
    s = _applied(spark, sf).withColumn("signature", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    return context.secondary_context(s)


@query("ctx_01_build_context")
def _(spark, sf):
    s = _found(spark, sf).withColumn("signature", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    return context.build_context(s, "small ring")


@query("ctx_12_model_summaries")
def _(spark, sf):
    s = _applied(spark, sf).withColumn("signature", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    return models.summaries(context.chunks_for_query(s, ["ring"]), "small ring").select("file", "summary")


@query("str_41_query_chunks", "SELECT file, count(*) AS symbols FROM (" + R.SYMBOLS + ") GROUP BY file HAVING least(count(*), 8) * 30 > 130 ORDER BY file")
def _(spark, sf):
    s = _applied(spark, sf).withColumn("signature", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    files = context.chunks_for_query(s, ["ring"]).select("file").distinct()
    return s.groupBy("file").agg(F.count("*").alias("symbols")).join(files, "file", "left_semi")


# --- scope -------------------------------------------------------------------------------------------

_SC = lambda t, base: f"SELECT path, floor({base} + log2(count(*) + 1) * 6 + 0.5)::BIGINT AS s, count(*) AS n FROM ({_literal_sql(t)}) GROUP BY path"


@query("rnk_17_scope_scores", f"SELECT path, CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE greatest(a.s, b.s) + 15 END AS score, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS grep_matches FROM ({_SC('ering', 50)}) a FULL JOIN ({_SC('anthe', 50)}) b USING (path)")
def _(spark, sf):
    return scope.text_scores(corpus(spark, sf), ["ering", "anthe"], max_hits=None, extensions=None).select("path", *BIG("score", "grep_matches"))


@query("rnk_17_scope_phrase_fallback", f"SELECT path, CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE greatest(a.s, b.s) + 15 END + CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN 25 ELSE 0 END AS score FROM ({_SC('edtion', 55)}) a FULL JOIN ({_SC('ouon', 55)}) b USING (path)")
def _(spark, sf):
    return scope.text_scores(corpus(spark, sf), ["edtion ouon"], max_hits=None, extensions=None).select("path", *BIG("score"))


@query("agg_12_hits_per_file", f"SELECT path, count(*) AS hits FROM ({_literal_sql('anthe')}) GROUP BY path")
def _(spark, sf):
    from ..operators import aggregates
    return aggregates.hits_per_file(grep.search_literal(corpus(spark, sf), "anthe", max_results=None), None)


@query("cls_11_scope_command_run")
def _(spark, sf):
    s = scope.Scope()
    return scope.run_command(s, "/grep ering anthe", corpus(spark, sf), extensions=None).select("path", *BIG("score"), "source")


@query("top_07_tiered_rank", f"SELECT path, line, (10 + 3)::BIGINT AS score FROM (SELECT path, line, min((ord, line, col)) AS o FROM ({_literal_sql('anthe', limit=300)}) GROUP BY 1, 2) ORDER BY o LIMIT 40")
def _(spark, sf):
    h = grep.search_literal(corpus(spark, sf), "anthe", max_results=300)
    h = h.select("path", "line", "match_line", F.struct("ord", "line", "column").alias("ord"))
    return topk.rank_hits(h, "anthe", 40).select("path", *BIG("line", "score"))
