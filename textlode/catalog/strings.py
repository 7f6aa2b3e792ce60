"""Scalar functions and predicates over whole columns."""

from pyspark.sql import functions as F

from ..functions import classify, fixed, markup, paths, text
from ..operators import cobol, rank
from . import registry as R
from .registry import joined, query, table


def _cols(name, tab, make, sql, where=None):
    def run(spark, sf):
        return table(spark, sf, tab).select(*make())
    query(name, sql)(run)


c = F.col  # shorthand
NAME = "replace(p_name, ' ', '_')"


def name_():
    return F.replace("p_name", F.lit(" "), F.lit("_"))


def camel():
    return F.concat(F.regexp_extract("p_name", "^(\\S+)", 1), text.capital(F.regexp_extract("p_name", "(\\S+)$", 1)))


CAMEL = "regexp_extract(p_name, '^(\\S+)', 1) || upper(left(regexp_extract(p_name, '(\\S+)$', 1), 1)) || substring(regexp_extract(p_name, '(\\S+)$', 1), 2)"

# --- tokenizers, stems, n-grams --------------------------------------------------

_cols("str_08_vector_tokens", "documents", lambda: ["doc_id", F.size(text.vector_tokens(c("text"))).cast("bigint").alias("n"),
                                                   joined(text.vector_tokens(c("text"))).alias("tokens")],
      f"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, {R.vector_tokens('text')} AS t FROM documents)")
_cols("str_09_learner_tokens", "documents", lambda: ["doc_id", joined(text.learner_tokens(c("text"))).alias("tokens")],
      f"SELECT doc_id, array_to_string({R.learner_tokens('text')}, '|') AS tokens FROM documents")
_cols("str_04_alnum_trigrams", "benchmark", lambda: ["item_id", joined(text.alnum_trigrams(c("text"))).alias("tris")],
      f"SELECT item_id, array_to_string({R.grams('s')}, '|') AS tris FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM benchmark)")
_cols("str_05_raw_trigrams", "benchmark", lambda: ["item_id", F.size(text.raw_trigrams(c("text"))).cast("bigint").alias("n"),
                                                  F.md5(joined(text.raw_trigrams(c("text")))).alias("tris")],
      f"SELECT item_id, len(t) AS n, md5(array_to_string(t, '|')) AS tris FROM (SELECT item_id, list_filter({R.grams('s')}, lambda g: NOT regexp_full_match(g, '\\s+')) AS t "
      "FROM (SELECT item_id, lower(text) AS s FROM benchmark))")
_cols("str_06_trigram_similarity", "part", lambda: ["p_partkey", F.round(text.trigram_similarity(c("p_name"), c("p_type")), 6).alias("sim"),
                                                   F.round(text.trigram_similarity(c("p_name"), F.lit("small gadget")), 6).alias("sim_lit")],
      "WITH t AS (SELECT p_partkey, p_name, p_type, list_distinct(" + R.grams("a") + ") AS ta, list_distinct(" + R.grams("b") + ") AS tb, list_distinct(" + R.grams("q") + ") AS tq FROM "
      "(SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS b, 'smallgadget' AS q FROM part)) "
      "SELECT p_partkey, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS sim, round(len(list_intersect(ta, tq)) / len(list_distinct(list_concat(ta, tq))), 6) AS sim_lit FROM t")
_cols("str_07_djb2_hash", "part", lambda: ["p_partkey", text.djb2(c("p_name")).cast("bigint").alias("h")],
      "SELECT p_partkey, list_reduce(list_concat([5381::BIGINT], list_transform(string_split(p_name, ''), lambda x: unicode(x)::BIGINT)), "
      "lambda h, x: ((h * 33 + x + 2147483648) & 4294967295) - 2147483648) AS h FROM part")


@query("idx_09_stemmer", f"SELECT word, {R.stem('word')} AS stem FROM (SELECT DISTINCT unnest({R.index_tokens('text')}) AS word FROM documents)")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(text.index_tokens(c("text"))).alias("word")).distinct()
    return w.select("word", text.stem(c("word")).alias("stem"))


@query("prj_01_stop_words", f"SELECT word, word IN {R.sql_in(fixed.UNIVERSAL_STOP_WORDS)} AS stop FROM (SELECT DISTINCT unnest({R.vector_tokens('text')}) AS word FROM documents)")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(text.vector_tokens(c("text"))).alias("word")).distinct()
    return w.select("word", c("word").isin(*fixed.UNIVERSAL_STOP_WORDS).alias("stop"))


@query("prj_02_garbage_symbols", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents) WHERE NOT (length(w) < 2 OR lower(w) IN "
       f"{R.sql_in(fixed.GARBAGE_WORDS)} OR regexp_full_match(w, '[0-9]+')) GROUP BY w")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    return w.filter(~text.is_garbage_symbol(c("w"))).groupBy("w").agg(F.count("*").alias("n"))


# --- scores -----------------------------------------------------------------------

_cols("str_01_levenshtein", "part", lambda: ["p_partkey", F.levenshtein("p_name", F.lit("small gadget")).cast("bigint").alias("d"),
                                            F.levenshtein("p_name", F.lower("p_type")).cast("bigint").alias("d2")],
      "SELECT p_partkey, levenshtein(p_name, 'small gadget') AS d, levenshtein(p_name, lower(p_type)) AS d2 FROM part")
_cols("str_02_camel_initials", "customer", lambda: ["c_custkey", text.camel_initials(c("c_name")).alias("initials"), text.matches_initials(F.lit("cu"), c("c_name")).alias("m1"),
                                                   text.matches_initials(F.lit("c"), c("c_name")).alias("m2")],
      "SELECT c_custkey, i AS initials, i = 'CU' OR i LIKE 'CU%' AS m1, i = 'C' AS m2 FROM (SELECT c_custkey, regexp_replace(c_name, '[^A-Z]', '', 'g') AS i FROM customer)")
_cols("str_03_subsequence", "part", lambda: ["p_partkey", text.is_subsequence(F.lit("srg"), c("p_name")).alias("m"), text.is_subsequence(F.left("p_type", F.lit(2)), c("p_name")).alias("m2")],
      "SELECT p_partkey, regexp_matches(lower(p_name), 's.*r.*g') AS m, regexp_matches(lower(p_name), lower(substring(p_type, 1, 1)) || '.*' || lower(substring(p_type, 2, 1))) AS m2 FROM part")

FUZZY_SQL = """CASE WHEN lower(t) = q THEN 100.0 WHEN starts_with(lower(t), q) THEN 95.0
 WHEN instr(lower(t), q) > 0 AND regexp_matches(substring(lower(t), instr(lower(t), q) - 1, 1), '[^a-z0-9]') THEN 90.0
 WHEN instr(lower(t), q) > 0 THEN 85.0
 WHEN regexp_replace(t, '[^A-Z]', '', 'g') = upper(q) OR (length(q) >= 2 AND starts_with(regexp_replace(t, '[^A-Z]', '', 'g'), upper(q))) THEN 80.0
 WHEN regexp_matches(lower(t), array_to_string(string_split(q, ''), '.*')) THEN 60 + length(q) / length(t) * 20
 WHEN 1 - levenshtein(q, lower(t)) / greatest(length(q), length(t)) > 0.5 THEN (1 - levenshtein(q, lower(t)) / greatest(length(q), length(t))) * 50 ELSE 0.0 END"""
_cols("rnk_11_fuzzy_score", "part", lambda: ["p_partkey"] + [F.round(text.fuzzy_score(F.lit(q), camel()), 6).alias(f"s_{q}") for q in ("small", "ring", "sr", "bluebolt", "smalgadget")],
      "SELECT p_partkey, " + ", ".join(f"round((SELECT {FUZZY_SQL} FROM (SELECT '{q}' AS q)), 6)::DOUBLE AS s_{q}" for q in ("small", "ring", "sr", "bluebolt", "smalgadget"))
      + f" FROM (SELECT p_partkey, {CAMEL} AS t FROM part)")
_cols("rnk_10_name_score", "part", lambda: ["p_partkey", text.name_score(F.lit("ring"), name_()).cast("bigint").alias("a"), text.name_score(F.lit("small"), name_()).cast("bigint").alias("b"),
                                           text.name_score(F.lit("red_widget"), name_()).cast("bigint").alias("d")],
      "SELECT p_partkey, " + ", ".join(f"CASE WHEN n = '{p}' THEN 100 WHEN starts_with(n, '{p}') THEN 90 WHEN contains(n, '{p}') THEN 70 ELSE 0 END::BIGINT AS {a}"
                                       for p, a in (("ring", "a"), ("small", "b"), ("red_widget", "d"))) + f" FROM (SELECT p_partkey, {NAME} AS n FROM part)")

# --- query terms --------------------------------------------------------------------

_sing = lambda w: f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"


@query("str_14_singular", f"SELECT w, {_sing('w')} AS s FROM (SELECT DISTINCT unnest({R.vector_tokens('text')}) AS w FROM documents)")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(text.vector_tokens(c("text"))).alias("w")).distinct()
    return w.select("w", text.singular(c("w")).alias("s"))


def _sorted(col):
    return joined(F.array_sort(col))


def _conv(name, make, sql_cols):
    _cols(name, "conversations", lambda: ["conv_id", "turn"] + make(), f"SELECT conv_id, turn, {sql_cols} FROM conversations")


SP = "array_to_string(list_sort({}), '|')"
WORDS = "list_filter(list_transform(string_split_regex(lower(text), '[\\s,;:]+'), lambda w: regexp_replace(w, '[^a-z0-9_]', '', 'g')), lambda w: length(w) >= 2)"
IDS = "list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w))"
_conv("str_10_search_terms", lambda: [_sorted(text.search_terms(c("text"))).alias("terms")],
      SP.format("list_distinct(list_filter(list_concat(b, list_filter(list_transform(b, lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN (" + _sing("w") + ") END), lambda w: length(w) >= 3)), lambda w: length(w) >= 2))")
      + f" AS terms FROM (SELECT conv_id, turn, list_concat({WORDS}, {IDS}) AS b FROM conversations) --")
_conv("str_15_scope_terms", lambda: [_sorted(text.scope_terms(c("text"))).alias("terms")],
      SP.format("list_distinct(list_concat(b, list_transform(b, lambda w: " + _sing("w") + ")))")
      + " AS terms FROM (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda w: length(w) >= 2 AND w NOT IN "
      + R.sql_in(fixed.SCOPE_STOP_WORDS) + ") AS b FROM conversations) --")
_conv("str_16_search_keywords", lambda: [_sorted(text.search_keywords(c("text"))).alias("terms")],
      SP.format("list_distinct(list_concat(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_-]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND w NOT IN " + R.sql_in(fixed.KEYWORD_STOP_WORDS)
                + f"), list_filter({IDS}, lambda w: length(w) > 3 AND w NOT IN " + R.sql_in(fixed.KEYWORD_STOP_WORDS) + ")))") + " AS terms")
_conv("str_17_fallback_keywords", lambda: [_sorted(text.fallback_keywords(c("text"))).alias("terms")],
      SP.format("list_distinct(list_concat(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_-]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND w NOT IN " + R.sql_in(fixed.FALLBACK_STOP_WORDS)
                + "), list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*(?:_[a-zA-Z0-9_]+)+|[a-zA-Z][a-z]*(?:[A-Z][a-z]*)*'), lambda w: lower(w))))") + " AS terms")
_conv("str_18_context_terms", lambda: [joined(text.context_terms(c("text"))).alias("terms")],
      "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda w: length(w) >= 2 AND w NOT IN "
      + R.sql_in(fixed.CONTEXT_STOP_WORDS) + "), lambda w: replace(w, '_', '')), '|') AS terms")
_conv("str_21_first_keywords", lambda: [joined(text.first_keywords(c("text"), 10)).alias("terms")],
      "array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2)[1:10], '|') AS terms")
_W19 = "list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) >= 3), lambda w: regexp_replace(w, '[^a-z0-9_]', '', 'g'))"
_conv("str_19_workspace_terms", lambda: [_sorted(text.workspace_terms(c("text"))).alias("terms")],
      SP.format("list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: left(w[i], 4) || left(w[i + 1], 5)), list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]), w, "
                "list_filter(list_transform(w, lambda x: regexp_replace(regexp_replace(x, '(ing|tion|tions|ness|ment|s)$', ''), 'e$', '')), lambda x: length(x) >= 3)))")
      + f" AS terms FROM (SELECT conv_id, turn, {_W19} AS w FROM conversations) --")
_conv("str_20_instruction_terms", lambda: [_sorted(text.instruction_terms(c("text"))).alias("terms")],
      SP.format("list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)(?:from|like|based on|learn from|patterns? from|handling from)\\s+(\\w+)', 1), "
                "regexp_extract_all(text, '(?i)(\\w+)\\s+(?:patterns?|validation|handling|logic|style)', 1)), lambda w: lower(w)), lambda w: w NOT IN " + R.sql_in(fixed.INSTRUCTION_SKIP_WORDS) + "))") + " AS terms")

_Q11 = lambda: F.concat(F.lit("how is the "), "p_name", F.lit(" built and scanned "), F.lower("p_type"))
_cols("str_11_compound_terms", "part", lambda: ["p_partkey", _sorted(text.compound_terms(_Q11(), F.split("p_name", " "))).alias("terms")],
      "SELECT p_partkey, " + SP.format("list_distinct(flatten(list_transform(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 3), lambda t: flatten(list_transform(['built', 'scann'], lambda a: "
                                       "[(" + _sing("t") + ") || '_' || a, a || '_' || (" + _sing("t") + ")])))))") + " AS terms FROM part")
_cap = "upper(left({0}, 1)) || substring({0}, 2)".format
_cols("str_12_naming_variants", "part", lambda: ["p_partkey", joined(text.naming_variants(c("p_name"))).alias("v")],
      "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS v FROM (SELECT p_partkey, list_transform(list_filter(list_transform(range(1, len(f) + 1), lambda i: {'i': i, 'x': f[i]}), "
      "lambda s: s.x IS NOT NULL AND list_position(f, s.x) = s.i), lambda s: s.x) AS list_distinct_ordered FROM (SELECT p_partkey, [p_name, p_name, array_to_string(w, ''), array_to_string(w, '_'), upper(array_to_string(w, '_')), "
      f"w[1] || array_to_string(list_transform(w[2:], lambda x: {_cap('x')}), ''), array_to_string(list_transform(w, lambda x: {_cap('x')}), '')] AS f FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)))")
_cols("str_13_topic_variants", "part", lambda: ["p_partkey", joined(text.topic_variants(c("p_name"))).alias("v")],
      "SELECT p_partkey, array_to_string([p_name, array_to_string(w, '_'), "
      f"w[1] || array_to_string(list_transform(w[2:], lambda x: {_cap('x')}), ''), array_to_string(list_transform(w, lambda x: {_cap('x')}), ''), upper(array_to_string(w, '_')), array_to_string(w, '-'), array_to_string(w, '')], '|') AS v "
      "FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)")


@query("top_15_keyword_union", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(" + R.vector_tokens("text") + f", {IDS}))), '|') AS words FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", _sorted(F.array_union(
        text.vector_tokens(c("text")), F.transform(text.identifiers(c("text")), F.lower))).alias("words"))


# --- names ----------------------------------------------------------------------------

_cols("prs_14_summary_from_name", "part", lambda: ["p_partkey", text.summary_from_name(camel()).alias("s"), text.summary_from_name(name_()).alias("s2")],
      f"SELECT p_partkey, {_cap('p_name')} AS s, {_cap('p_name')} AS s2 FROM part")
_cols("prs_15_verb_summary", "part", lambda: ["p_partkey", text.verb_summary(F.concat(F.lit("get_"), name_())).alias("s"), text.verb_summary(name_()).alias("s2")],
      f"SELECT p_partkey, 'Gets ' || p_name AS s, array_to_string(list_transform(string_split(p_name, ' '), lambda x: {_cap('x')}), ' ') AS s2 FROM part")
_cols("grf_12_node_id", "part", lambda: ["p_partkey", text.node_id(F.concat("p_name", F.lit("::"), "p_brand")).alias("id")],
      "SELECT p_partkey, regexp_replace(p_name || '::' || p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS id FROM part")
_cols("str_25_escape_regex", "documents", lambda: ["doc_id", F.md5(text.escape_regex(c("text"))).alias("e")],
      "SELECT doc_id, md5(regexp_replace(text, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g')) AS e FROM documents")

# --- paths ------------------------------------------------------------------------------

_PATH = lambda: F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
_P = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p FROM pages"


def _page(name, make, sql):
    _cols(name, "pages", lambda: ["page_id"] + make(_PATH()), f"SELECT page_id, {sql} FROM ({_P})")


_page("str_32_normalize_path", lambda p: [paths.normalize(F.replace(p, F.lit("/"), F.lit("\\"))).alias("p")], "p AS p")
_FN = "regexp_extract(p, '[^/]*$')"
_page("str_33_path_parts", lambda p: [paths.file_name(p).alias("name"), paths.parent_dir(p).alias("parent"), paths.dir_name(p).alias("dir"),
                                      joined(paths.split_path(p)).alias("parts"), paths.relative_to(p, F.substring_index(p, "/", 1)).alias("rel")],
      f"{_FN} AS name, regexp_replace(p, '/?[^/]*$', '') AS parent, regexp_extract(regexp_replace(p, '/?[^/]*$', ''), '[^/]*$') AS dir, "
      "array_to_string(list_filter(string_split(p, '/'), lambda x: length(x) > 0), '|') AS parts, substring(p, instr(p, '/') + 1) AS rel")
_page("str_34_base_name", lambda p: [paths.base_name(p).alias("b")], f"CASE WHEN regexp_matches({_FN}, '^.+\\.[^.]*$') THEN regexp_extract({_FN}, '^(.+)\\.[^.]*$', 1) ELSE {_FN} END AS b")
_page("str_35_extension", lambda p: [paths.extension(p).alias("e")], f"regexp_extract({_FN}, '^.+(\\.[^.]*)$', 1) AS e")
_page("str_36_inside_directory", lambda p: [paths.is_inside(p, F.substring_index(p, "/", 2)).alias("a"), paths.is_inside(p, F.lit("m.therou")).alias("b")],
      "starts_with(p, array_to_string(string_split(p, '/')[1:2], '/') || '/') OR p = array_to_string(string_split(p, '/')[1:2], '/') AS a, starts_with(p, 'm.therou/') OR p = 'm.therou' AS b")
_page("str_37_short_dir", lambda p: [paths.short_dir(p).alias("d")], "array_to_string(string_split(regexp_replace(p, '/?[^/]*$', ''), '/')[-2:], '/') AS d")
_cols("str_30_page_id", "pages", lambda: ["page_id", markup.page_id(F.concat(F.regexp_replace("url", "/(en|fr|de|es)/", "/pages/"), F.lit(" "))).alias("id"),
                                         markup.page_id(F.replace("url", F.lit("page="), F.lit("pageId="))).alias("id2")],
      "SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/(en|fr|de|es)/', '/pages/'), '/pages/(\\d+)', 1), '') AS id, nullif(regexp_extract(replace(url, 'page=', 'pageId='), 'pageId=(\\d+)', 1), '') AS id2 FROM pages")
_cols("str_31_base_url", "pages", lambda: ["page_id", markup.base_url(F.regexp_replace("url", "/(en|fr)/", "/wiki/")).alias("b")],
      "SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/(en|fr)/', '/wiki/'), '(https?://[^/]+/wiki)', 1), '') AS b FROM pages")
_cols("str_38_human_size", "documents", lambda: ["doc_id", paths.human_size(c("n_chars")).alias("a"), paths.human_size(c("n_chars") * 1024).alias("b")],
      "SELECT doc_id, " + ", ".join(f"CASE WHEN {e} < 1024 THEN {e} || ' B' WHEN {e} < 1048576 THEN printf('%.1f', floor(({e}) / 1024.0 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(({e}) / 1048576.0 * 10 + 0.5) / 10) || ' MB' END AS {a}"
                                    for e, a in (("n_chars", "a"), ("n_chars * 1024", "b"))) + " FROM documents")

# --- file predicates -----------------------------------------------------------------------

_FILE = lambda: F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("_"), c("p_partkey").cast("string"), F.lit("."), F.get(F.array(
    *[F.lit(x) for x in ("c", "MD", "py", "json", "png", "cbl", "min.js", "java", "d.ts", "lock")]), (c("p_partkey") % 10).cast("int")))
_F = "SELECT p_partkey, replace(p_name, ' ', '/') || '_' || p_partkey || '.' || ['c', 'MD', 'py', 'json', 'png', 'cbl', 'min.js', 'java', 'd.ts', 'lock'][p_partkey % 10 + 1] AS f FROM part"


def _file(name, make, sql):
    _cols(name, "part", lambda: ["p_partkey"] + make(_FILE()), f"SELECT p_partkey, {sql} FROM ({_F})")


_EXT = "lower(regexp_extract(f, '[^.]*$'))"
_file("src_03_binary_predicate", lambda f: [paths.is_binary(f).alias("b")], f"{_EXT} IN {R.sql_in(fixed.BINARY_EXTENSIONS)} AS b")
_LANG = f"coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in fixed.LANGUAGE_BY_EXTENSION.items())}}}[{_EXT}], {_EXT})"
_file("src_04_language", lambda f: [paths.language(f).alias("lang")], f"{_LANG} AS lang")
_file("src_05_language_extended", lambda f: [paths.language(f, extended=True).alias("lang")], f"{_LANG} AS lang")
_file("src_07_should_index", lambda f: [paths.should_index(f).alias("ok")],
      f"{_EXT} NOT IN {R.sql_in(fixed.EXCLUDED_EXTENSIONS)} AND NOT regexp_matches(f, '\\.min\\.|\\.bundle\\.|\\.generated\\.|\\.d\\.ts$|node_modules/|vendor/|\\.git/|dist/|build/|out/|(?i)^(readme|changelog|license|contributing|authors)') AS ok")
_file("src_08_is_source", lambda f: [paths.is_source(paths.language(f)).alias("s")], f"{_LANG} IN {R.sql_in(fixed.CODE_LANGUAGES)} AS s")
_file("prj_03_file_pattern", lambda f: [paths.matches_file_pattern(f, "Small/").alias("a"), paths.matches_file_pattern(f, r"^blue.*\.c$", regex=True).alias("b")],
      "contains(lower(f), 'small/') AS a, regexp_matches(f, '^blue.*\\.c$') AS b")
_file("prj_04_exclude_filter", lambda f: [paths.grep_excluded(f).alias("x")], "regexp_matches(f, 'node_modules|\\.min\\.js$|\\.map$|dist/|build/') AS x")
_file("prj_05_folder_filter", lambda f: [paths.folder_allowed(F.substring_index(f, "/", 1), ("re", "sm"), ("mal",)).alias("ok")],
      "NOT contains(split_part(f, '/', 1), 'mal') AND (contains(split_part(f, '/', 1), 're') OR contains(split_part(f, '/', 1), 'sm')) AS ok")


@query("src_09_grep_corpus", f"SELECT path, len(string_split(content, chr(10))) AS lines FROM ({R.DOCS}) WHERE length(content) > 0")
def _(spark, sf):
    from ..operators.grep import grep_corpus
    return grep_corpus(R.corpus(spark, sf)).select("path", text.line_count(c("content")).cast("bigint").alias("lines"))


_cols("rnk_28_workspace_score", "part", lambda: ["p_partkey", rank.workspace_file_score(F.concat(F.lit("/src/"), _FILE()), ["small", "ring"]).cast("bigint").alias("s")],
      "SELECT p_partkey, (10 + CASE WHEN contains(n, 'small') THEN 30 ELSE 0 END + CASE WHEN contains(p, 'small') THEN 10 ELSE 0 END + CASE WHEN contains(n, 'ring') THEN 30 ELSE 0 END "
      "+ CASE WHEN contains(p, 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(p, 'test') THEN 0 ELSE 10 END + 15 + CASE WHEN e IN ('.java', '.py', '.js', '.ts', '.go', '.c', '.cpp', '.rs') THEN 20 ELSE 0 END "
      f"- CASE WHEN e IN ('.md', '.txt', '.html') THEN 15 ELSE 0 END)::BIGINT AS s FROM (SELECT p_partkey, lower('/src/' || f) AS p, lower(regexp_extract(f, '[^/]*$')) AS n, lower(regexp_extract(f, '\\.[^.]*$')) AS e FROM ({_F}))")
_cols("rnk_21_keyword_file_score", "part", lambda: ["p_partkey", F.least(rank.keyword_file_score(F.concat(F.lit("src/"), _FILE()), ["rings", "small"]), F.lit(200)).cast("bigint").alias("s")],
      "SELECT p_partkey, least(200, " + " + ".join(f"CASE WHEN st = '{t}' THEN 100 WHEN starts_with(st, '{t}') THEN 60 WHEN contains(n, '{t}') THEN 25 ELSE 0 END + CASE WHEN contains(p, '/{t}/') THEN 15 ELSE 0 END"
                                                   for t in ("rings", "ring", "small"))
      + f")::BIGINT AS s FROM (SELECT p_partkey, lower('src/' || f) AS p, lower(regexp_extract(f, '[^/]*$')) AS n, regexp_replace(lower(regexp_extract(f, '[^/]*$')), '\\.[^.]+$', '') AS st FROM ({_F}))")

# --- markup and cleaning -------------------------------------------------------------------------


def _chain(col, rules):
    for p, r in rules:
        r = r.replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '")
        flags = "gi" if p.startswith("(?i)") else "g"
        col = f"regexp_replace({col}, '{p.replace('(?i)', '')}', '{r}', '{flags}')"
    return col


_cols("str_28_to_markdown", "pages", lambda: ["page_id", F.length(markup.to_markdown(c("html"))).cast("bigint").alias("n"), F.md5(markup.to_markdown(c("html"))).alias("md")],
      "SELECT page_id, length(m) AS n, md5(m) AS md FROM (SELECT page_id, regexp_replace(regexp_replace(" + _chain("html", markup.TO_MARKDOWN) + ", '^\\s+', ''), '\\s+$', '') AS m FROM pages)")
_MD = "'# ' || p_name || chr(10) || 'some **' || p_type || '** text' || chr(10) || chr(10) || 'end ' || p_brand"
_cols("str_29_to_wiki", "part", lambda: ["p_partkey", markup.to_wiki(F.concat(F.lit("# "), "p_name", F.lit("\nsome **"), "p_type", F.lit("** text\n\nend "), "p_brand")).alias("w")],
      "SELECT p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || 'some <strong>' || p_type || '</strong> text</p><p>end ' || p_brand || '</p>' AS w FROM part")
_cols("str_26_clean_text", "documents", lambda: ["doc_id", F.md5(text.clean_text(c("text"))).alias("t")],
      "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([.!?])\\n([A-Z])', '\\1' || chr(10) || chr(10) || '\\2', 'g'), '^\\s+', ''), '\\s+$', '')) AS t FROM documents")


@query("str_27_detect_headings", "WITH l AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i]) AS s, i = 1 AS first, i > 1 AND trim(coalesce(ls[i - 1], '')) = '' AS prev_empty, i < len(ls) AND trim(coalesce(ls[i + 1], '')) = '' AS next_empty "
       "FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))), "
       "m AS (SELECT *, length(s) > 0 AND length(s) < 80 AND NOT regexp_matches(s, '[.,;:]$') AND (first OR prev_empty) AS stand FROM l) "
       "SELECT doc_id, count_if(stand AND length(s) > 3 AND upper(s) = s AND lower(s) <> s) AS major, count_if(stand AND NOT (length(s) > 3 AND upper(s) = s AND lower(s) <> s) AND upper(left(s, 1)) = left(s, 1) AND lower(left(s, 1)) <> left(s, 1) AND length(s) < 50 AND next_empty) AS minor FROM m GROUP BY 1")
def _(spark, sf):
    from ..sources.documents import detect_headings
    marked = detect_headings(table(spark, sf, "documents"), "doc_id")
    return marked.select("doc_id", F.regexp_count("markdown", F.lit("(?m)^## ")).cast("bigint").alias("major"), F.regexp_count("markdown", F.lit("(?m)^### ")).cast("bigint").alias("minor"))


_cols("src_17_document_header", "documents", lambda: ["doc_id", markup.document_header(F.concat("source", F.lit(".pdf")), F.upper("lang"), (c("n_chars") / 3000).cast("int"), F.lit(0)).alias("h")],
      "SELECT doc_id, '[Document: ' || source || '.pdf]' || chr(10) || '[Format: ' || upper(lang) || ']' || chr(10) || CASE WHEN n_chars // 3000 > 0 THEN '[Pages: ' || n_chars // 3000 || ']' || chr(10) ELSE '' END || chr(10) AS h FROM documents")
_cols("str_22_comments", "pages", lambda: ["page_id", joined(text.comment_texts(c("html"), F.lit("javascript"))).alias("t")],
      "SELECT page_id, array_to_string(list_concat(regexp_extract_all(html, '//([^\\n\\r]+)', 1), regexp_extract_all(html, '(/\\*(?s:.)*?\\*/)', 1)), '|') AS t FROM pages")
_cols("str_23_string_literals", "pages", lambda: ["page_id", joined(F.array_sort(text.string_literals(c("html")))).alias("t")],
      "SELECT page_id, array_to_string(list_sort(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(html, '\"(?:[^\"\\\\]|\\\\.)*\"'), regexp_extract_all(html, '''(?:[^''\\\\]|\\\\.)*''')), regexp_extract_all(html, '`(?:[^`\\\\]|\\\\.)*`')), "
      "lambda s: substring(s, 2, length(s) - 2)), lambda s: true)), '|') AS t FROM pages")
_cols("str_24_strip_code", "pages", lambda: ["page_id", F.md5(text.strip_code(c("html"), F.lit("javascript"))).alias("t")],
      "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '//[^\\n\\r]+', ' ', 'g'), '/\\*(?s:.)*?\\*/', ' ', 'g'), '\"(?:[^\"\\\\]|\\\\.)*\"', '\"\"', 'g'), '''(?:[^''\\\\]|\\\\.)*''', '''''', 'g'), '`(?:[^`\\\\]|\\\\.)*`', '``', 'g')) AS t FROM pages")

# --- classification -----------------------------------------------------------------------------------

_QUESTION = lambda: F.concat(F.get(F.array(*[F.lit(x) for x in QS]), (c("p_partkey") % len(QS)).cast("int")), F.lit(" "), name_())
QS = ("who calls", "what does this code do", "explain", "show fields in", "find", "nothing about", "explain this code", "how does", "callees of", "usages of", "list the main parts of")
_QSQL = f"SELECT p_partkey, p_type, p_name, {NAME} AS n, {[q for q in QS]}[p_partkey % {len(QS)} + 1] || ' ' || {NAME} AS q, p_partkey % {len(QS)} AS k FROM part"


def _question(name, make, sql):
    _cols(name, "part", lambda: ["p_partkey"] + make(_QUESTION()), f"SELECT p_partkey, {sql} FROM ({_QSQL})")


_question("cls_01_intent", lambda q: [classify.intent(q)["intent"].alias("intent"), classify.intent(q)["target"].alias("target")],
          "['callers', 'general', 'explain', 'structure', 'find', 'general', 'explain', 'explain', 'callees', 'callers', 'find'][k + 1] AS intent, "
          "CASE k WHEN 1 THEN q WHEN 5 THEN q WHEN 6 THEN 'this code ' || n WHEN 10 THEN 'the main parts of ' || n ELSE n END AS target")
_question("cls_02_overview", lambda q: [classify.is_overview(q).alias("o")], "k IN (1, 6, 10) AS o")
_question("cls_03_domain", lambda q: [classify.is_domain(F.concat(F.lit("how is "), q, F.lit(" handled"))).alias("d"), classify.is_domain(F.concat(q, F.lit(" trace the flow"))).alias("d2")],
          "k = 7 AS d, true AS d2")
_question("cls_04_query_class", lambda q: [classify.query_class(q).alias("c")], "CASE WHEN k IN (1, 6, 10) THEN 'overview' WHEN k = 4 THEN 'specific' ELSE 'general' END AS c")
_question("cls_05_sub_questions", lambda q: [joined(classify.sub_questions(F.concat(F.lit("find the "), "p_name", F.lit(" and also "), q))).alias("s")],
          "CASE WHEN k IN (0, 1, 2, 3, 4, 6, 7, 10) THEN 'find the ' || p_name || '|' || q ELSE 'find the ' || p_name || ' and also ' || q END AS s")
_question("cls_06_search_plan", lambda q: [classify.search_plan(q)["type"].alias("type"), classify.search_plan(q)["function_name"].alias("f"), classify.search_plan(q)["is_call"].alias("is_call"),
                                           classify.search_plan(q)["is_usage"].alias("is_usage")],
          "CASE WHEN k IN (0, 9) THEN 'function_search' ELSE 'general' END AS type, CASE WHEN k IN (0, 9) THEN n END AS f, k = 0 AS is_call, k = 9 AS is_usage")
_question("rnk_29_boost_factors", lambda q: [F.round(v, 6).alias(k) for k, v in rank.boost_factors(q, classify.query_class(q)).items()],
          "round(CASE WHEN k IN (1, 6, 10) THEN 0.5 WHEN k = 4 THEN 2.0 ELSE 1.0 END * CASE WHEN k = 4 THEN 1.2 ELSE 1 END, 6)::DOUBLE AS sym, round(CASE WHEN k = 4 THEN 1.5 * 1.3 ELSE 1 END, 6)::DOUBLE AS tri, "
          "CASE WHEN k IN (3, 7) THEN 1.2 ELSE 1.0 END::DOUBLE AS vec, round(CASE WHEN k IN (1, 6, 10) THEN 2.5 WHEN k = 4 THEN 0.8 WHEN k IN (3, 7) THEN 1.3 ELSE 1.0 END, 6)::DOUBLE AS sum, CASE WHEN k IN (1, 6, 10) THEN 2.0 ELSE 1.0 END::DOUBLE AS file")
_cols("prj_16_error_response", "documents", lambda: ["doc_id", classify.is_error_response(c("text")).alias("e"), classify.is_error_response(F.concat("text", F.lit(" Rate  limit"))).alias("e2")],
      "SELECT doc_id, regexp_matches(text, '(?i)API\\s+(?:key|error|unavailable)|rate\\s+limit|no\\s+(?:LLM|model)\\s+available') AS e, true AS e2 FROM documents")
_COB = lambda: F.concat(F.get(F.array(*[F.lit(x) for x in CQ]), (c("p_partkey") % len(CQ)).cast("int")), F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")))
CQ = ("who calls", "explain", "find loop", "error handling in")
_CSQL = f"SELECT p_partkey, upper(replace(p_name, ' ', '-')) AS n, {[q for q in CQ]}[p_partkey % 4 + 1] || ' ' || replace(p_name, ' ', '-') AS q, p_partkey % 4 AS k FROM part"
_cols("cls_07_cobol_intent", "part", lambda: ["p_partkey", cobol.classify(_COB())["intent"].alias("intent"), cobol.classify(_COB())["division"].alias("division"), joined(cobol.classify(_COB())["boosts"]).alias("boosts")],
      "SELECT p_partkey, ['FIND_CALLERS', 'EXPLAIN_LOGIC', 'GENERAL_SEARCH', 'FIND_ERROR_HANDLING'][k + 1] AS intent, CASE WHEN k <> 2 THEN 'PROCEDURE' END AS division, "
      f"['perform|call using', 'perform|if|evaluate|compute', '', 'on exception|invalid key|sqlcode'][k + 1] AS boosts FROM ({_CSQL})")
_cols("cls_08_cobol_names", "part", lambda: ["p_partkey", joined(F.array_sort(cobol.query_names(_COB()))).alias("names")],
      f"SELECT p_partkey, array_to_string(list_sort(list_concat([n], [['CALLS'], ['EXPLAIN'], ['LOOP'], ['ERROR', 'HANDLING']][k + 1])), '|') AS names FROM ({_CSQL})")
_cols("cls_09_cobol_expansion", "part", lambda: ["p_partkey", joined(cobol.expand_terms(_COB())).alias("terms")],
      f"SELECT p_partkey, q || CASE k WHEN 2 THEN '|perform until|perform varying|perform times' WHEN 3 THEN '|on exception|invalid key|at end|sqlcode' ELSE '' END AS terms FROM ({_CSQL})")

_CMD = lambda: F.concat(F.get(F.array(*[F.lit(x) for x in CMDS]), (c("p_partkey") % len(CMDS)).cast("int")), F.lit(" "), "p_name")
CMDS = ("/grep", "/scope", "/search", "hello", "/GREP")
_MSQL = f"SELECT p_partkey, p_name, {[q for q in CMDS]}[p_partkey % 5 + 1] || ' ' || p_name AS q, p_partkey % 5 AS k FROM part"
_cols("cls_10_scope_command", "part", lambda: ["p_partkey", classify.scope_command(_CMD())["type"].alias("type"), classify.scope_command(_CMD())["args"].alias("args")],
      f"SELECT p_partkey, CASE WHEN k IN (0, 1, 4) THEN 'search' END AS type, CASE WHEN k IN (0, 1, 4) THEN p_name END AS args FROM ({_MSQL})")
_SCMD = lambda: F.concat(F.get(F.array(*[F.lit(x) for x in ("/tag ", "/show ", "/history ", "/compare 3 ", "say ")]), (c("p_partkey") % 5).cast("int")), c("p_size").cast("string"),
                         F.when(c("p_partkey") % 5 == 0, F.lit(" todo")).otherwise(F.lit("")))
_cols("cls_13_session_command", "part", lambda: ["p_partkey"] + [classify.session_command(_SCMD())[f].alias(f) for f in ("type", "arg1", "arg2")],
      "SELECT p_partkey, [ 'tag', 'show', 'history', 'compare', NULL][k + 1] AS type, [p_size::VARCHAR, p_size::VARCHAR, p_size::VARCHAR, '3', NULL][k + 1] AS arg1, ['todo', NULL, NULL, p_size::VARCHAR, NULL][k + 1] AS arg2 "
      "FROM (SELECT *, p_partkey % 5 AS k FROM part)")
_MOD = lambda: F.concat(F.when(c("p_size") % 2 == 0, F.lit("/source w,a ")).otherwise(F.lit("")), F.lit("/in Src,-test "), "p_name")
_cols("cls_15_modifiers", "part", lambda: ["p_partkey"] + [classify.modifiers(_MOD())[f].alias(f) for f in ("history", "workspace", "attachments", "query")]
      + [joined(classify.modifiers(_MOD())[f]).alias(f) for f in ("include", "exclude")],
      "SELECT p_partkey, p_size % 2 <> 0 AS history, p_size % 2 = 0 AS workspace, p_size % 2 = 0 AS attachments, p_name AS query, 'src' AS include, 'test' AS exclude FROM part")
_cols("cls_16_command_chain", "part", lambda: ["p_partkey", joined(F.transform(classify.command_chain(F.lit("requirements"), F.concat("p_name", F.lit(" /fediso now "), F.lower("p_type"), F.lit(" /gencode"))),
                                                                              lambda s: F.concat_ws(":", s["command"], s["query"]))).alias("steps")],
      "SELECT p_partkey, 'requirements:' || p_name || '|fediso:now ' || lower(p_type) || '|gencode:' AS steps FROM part")
_cols("cls_17_then_chain", "part", lambda: ["p_partkey", joined(F.transform(classify.then_chain(F.lit(""), F.concat("p_name", F.lit(" then /Describe it THEN translate "), "p_type")),
                                                                           lambda s: F.concat_ws(":", s["command"], s["query"]))).alias("steps")],
      "SELECT p_partkey, 'find:' || p_name || '|describe:it|translate:' || p_type AS steps FROM part")
_CIN = lambda: F.concat(F.get(F.array(*[F.lit(x) for x in ("#", "#files a.c, ", "files: ", "")]), (c("p_partkey") % 4).cast("int")), F.when(c("p_partkey") % 4 == 0, c("p_size").cast("string")).otherwise(name_()))
_cols("cls_18_command_input", "part", lambda: ["p_partkey", classify.command_input(_CIN())["type"].alias("type"), classify.command_input(_CIN())["value"].alias("value"), joined(classify.command_input(_CIN())["files"]).alias("files")],
      f"SELECT p_partkey, ['history', 'files', 'files', 'search'][k + 1] AS type, CASE k WHEN 0 THEN p_size::VARCHAR WHEN 3 THEN {NAME} END AS value, CASE k WHEN 1 THEN 'a.c|' || {NAME} WHEN 2 THEN {NAME} END AS files "
      "FROM (SELECT *, p_partkey % 4 AS k FROM part)")
_cols("str_43_references", "conversations", lambda: ["conv_id", "turn", classify.has_references(c("text")).alias("r"), classify.has_references(F.concat("text", F.lit(" see @"), c("turn").cast("string"), F.lit(".code[0]"))).alias("r2")],
      "SELECT conv_id, turn, regexp_matches(text, '(?i)@(\\d+|last)') AS r, true AS r2 FROM conversations")
