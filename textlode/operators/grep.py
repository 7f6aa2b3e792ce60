"""Literal, regex and call-site search over a corpus of (path, content, ord)."""

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, grammar, paths
from ..functions.matching import Rule, ascii_edges, match_rows, match_rows_by
from ..functions.text import escape_regex, line_count
from . import ordering

HIT_ORDER = ("ord", "line", "column")


def grep_corpus(files: DataFrame) -> DataFrame:
    """Files that text search reads: excluded paths and empty content dropped; files of any size are read."""
    return files.filter(~paths.grep_excluded(F.col("path")) & (F.length("content") > 0))


def corpus_lines(files: DataFrame) -> DataFrame:
    return files.select("path", "ord", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")) \
        .select("path", "ord", (F.col("i") + 1).alias("line"), "text")


def quote(pattern: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)


def _occurrences(text: Column, pattern: str) -> Column:
    """0-based offsets of every occurrence, overlapping ones included (zero-width split points)."""
    pieces = F.split(text, f"(?={quote(pattern)})", -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    return F.aggregate(
        pieces, state,
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.concat(s["hits"], F.array(s["at"])).alias("hits")),
        lambda s: F.filter(s["hits"], lambda at: F.substr(text, at + 1, F.lit(len(pattern))) == pattern))


def with_context(df: DataFrame, lines="lines", line="line", n=2) -> DataFrame:
    """Up to n lines before and after a 1-based line, from the file's line array."""
    at = F.col(line)
    first = F.greatest(at - n, F.lit(1))
    return df.withColumn("before", F.slice(lines, first, at - first)) \
        .withColumn("after", F.slice(lines, at + 1, F.lit(n)))


def search_literal(files: DataFrame, pattern: str, case_sensitive=False, whole_word=False,
                   max_results=None, file_pattern=None, context_lines=2) -> DataFrame:
    """Every occurrence of a literal with line, column and neighbouring lines.

    Lines are filtered before any offset is computed and nothing is shuffled until the
    final ordered limit, if ``max_results`` asks for one.
    """
    corpus = grep_corpus(files)
    if file_pattern is not None:
        corpus = corpus.filter(paths.matches_file_pattern(F.col("path"), file_pattern))
    fold = (lambda c: c) if case_sensitive else F.lower
    wanted = pattern if case_sensitive else pattern.lower()
    if "\n" in wanted:
        return _search_multiline(corpus, wanted, fold, whole_word, max_results, context_lines)
    corpus = corpus.filter(F.contains(fold(F.col("content")), F.lit(wanted)))
    hits = corpus.select("path", "ord", F.split("content", "\n", -1).alias("lines")) \
        .select("path", "ord", "lines", F.posexplode("lines").alias("i", "match_line")) \
        .filter(F.contains(fold(F.col("match_line")), F.lit(wanted))) \
        .withColumn("line", F.col("i") + 1)
    hits = with_context(hits, n=context_lines) \
        .select("path", "ord", "line", "match_line", "before", "after",
                F.explode(_occurrences(fold(F.col("match_line")), wanted)).alias("at")) \
        .withColumn("column", F.col("at") + 1) \
        .withColumn("match_text", F.substr("match_line", F.col("column"), F.lit(len(pattern))))
    if whole_word:
        behind = F.substr("match_line", F.col("column") + len(pattern), F.lit(1))
        ahead = F.when(F.col("at") > 0, F.substr("match_line", F.col("at"), F.lit(1))).otherwise(F.lit(" "))
        hits = hits.filter(~ahead.rlike(r"\w") & ~behind.rlike(r"\w"))
    hits = hits.select("path", "ord", "line", "column", "match_line", "match_text", "before", "after")
    return hits if max_results is None else ordering.top(hits, HIT_ORDER, max_results)


def search_literals(files: DataFrame, terms, per_term=None, context_lines=None) -> DataFrame:
    """Every occurrence of each of several literals, case folded: the columns of ``search_literal`` and ``leg``, the term's number.

    All terms share one scan: a line is tested for each term and only then searched.  ``per_term`` keeps the first hits of
    each term in file order, by a ranked filter that map tasks apply before the shuffle.
    """
    terms = [t.lower() for t in terms]
    corpus = grep_corpus(files)
    has = lambda text: [F.contains(F.lower(text), F.lit(t)) for t in terms]
    some = F.lit(False)
    for h in has(F.col("content")):
        some = some | h
    lines = corpus.filter(some).select("path", "ord", F.split("content", "\n", -1).alias("lines")) \
        .select("path", "ord", *([] if context_lines is None else ["lines"]), F.posexplode("lines").alias("i", "match_line")) \
        .withColumn("line", F.col("i") + 1)
    if context_lines is not None:
        lines = with_context(lines, n=context_lines)
    low = F.lower("match_line")
    found = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(i).alias("leg"), F.lit(len(t)).alias("size"), _occurrences(low, t).alias("at")))
                                      for i, (t, h) in enumerate(zip(terms, has(F.col("match_line")), strict=True))]))
    kept = ["path", "ord", "line", "match_line"] + ([] if context_lines is None else ["before", "after"])
    hits = lines.select(*kept, F.explode(found).alias("f")).select(*kept, F.col("f.leg").alias("leg"), F.col("f.size").alias("size"), F.explode("f.at").alias("at")) \
        .withColumn("column", F.col("at") + 1).withColumn("match_text", F.substr("match_line", F.col("column"), F.col("size"))).drop("at", "size")
    return hits if per_term is None else ordering.top_per_key(hits, ["leg"], list(HIT_ORDER), per_term).drop("rn")


def _search_multiline(corpus, wanted, fold, whole_word, max_results, context_lines):
    found = corpus.withColumn("__t", fold(F.col("content")))
    pattern = f"(?={quote(wanted)})"
    spots = found.filter(F.contains("__t", F.lit(wanted)))
    # a zero-width rule: pieces between occurrences carry the offsets
    pieces = F.split("__t", pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    offsets = F.aggregate(pieces, state, lambda s, p: F.struct(
        (s["at"] + F.length(p)).alias("at"), F.concat(s["hits"], F.array(s["at"])).alias("hits")), lambda s: s["hits"])
    rows = spots.select("path", "ord", "content", "__t", F.explode(offsets).alias("at")) \
        .filter(F.substr("__t", F.col("at") + 1, F.lit(len(wanted))) == wanted)
    if whole_word:
        ahead = F.when(F.col("at") > 0, F.substr("__t", F.col("at"), F.lit(1))).otherwise(F.lit(" "))
        behind = F.substr("__t", F.col("at") + len(wanted) + 1, F.lit(1))
        rows = rows.filter(~ahead.rlike(r"\w") & ~behind.rlike(r"\w"))
    head = F.left("content", F.col("at"))
    rows = rows.withColumn("line", line_count(head)) \
        .withColumn("column", F.length(F.substring_index(head, "\n", -1)) + 1) \
        .withColumn("lines", F.split("content", "\n", -1)) \
        .withColumn("match_line", F.get("lines", F.col("line") - 1)) \
        .withColumn("match_text", F.substr("content", F.col("at") + 1, F.lit(len(wanted))))
    rows = with_context(rows, n=context_lines).select(
        "path", "ord", "line", "column", "match_line", "match_text", "before", "after")
    return rows if max_results is None else ordering.top(rows, HIT_ORDER, max_results)


def attach_lines(hits: DataFrame, files: DataFrame, context_lines=2) -> DataFrame:
    """Join hits back to their file for the matched line and its neighbours."""
    lines = files.select("path", F.split("content", "\n", -1).alias("lines"))
    joined = hits.join(lines, "path").withColumn("match_line", F.get("lines", F.col("line") - 1))
    return with_context(joined, n=context_lines).drop("lines")


def search_regex(files: DataFrame, pattern: str, groups=0, flags="im",
                 max_results=None, file_pattern=None, context_lines=2) -> DataFrame:
    """Whole-file regex search; matches may span lines, have no width, and refer back to groups.

    ``groups`` capture groups are returned, however many.  A pattern that the JVM does not compile
    gives one row of the same columns: the reason in ``match_text``, everything else null.
    """
    corpus = grep_corpus(files)
    if file_pattern is not None:
        corpus = corpus.filter(paths.matches_file_pattern(F.col("path"), file_pattern))
    full = f"(?{flags}){pattern}" if flags else pattern
    reason = _invalid(files.sparkSession, ascii_edges(full))
    if reason:
        columns = attach_lines(_regex_hits(corpus.limit(0), "x", 0), corpus.limit(0), context_lines)
        bad = F.lit(f"Invalid regex: {reason}")
        return files.sparkSession.range(1).select(*[(bad if f.name == "match_text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in columns.schema])
    hits = _regex_hits(corpus.filter(F.col("content").rlike(ascii_edges(full))), full, groups)
    if max_results is not None:
        hits = ordering.top(hits, HIT_ORDER, max_results)
    return attach_lines(hits, corpus, context_lines)


def _invalid(spark, pattern: str):
    """Why the JVM does not compile a pattern, or None."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:  # PatternSyntaxException
        return str(e).splitlines()[0]


def _regex_hits(corpus: DataFrame, pattern: str, groups: int) -> DataFrame:
    """One rule for each three groups; a match's rows meet by their number."""
    rules = [Rule(pattern, tuple(range(k, min(k + 2, groups) + 1)), zero_width=True) for k in range(1, groups + 1, 3)] or [Rule(pattern, (0,), zero_width=True)]
    rows = match_rows(corpus, ["path", "ord"], "content", rules)
    kept = F.slice(F.array("g1", "g2", "g3"), 1, F.least(F.lit(3), F.lit(groups) - 3 * F.col("rule")))
    if len(rules) == 1:
        return rows.select("path", "ord", "line", "column", "match_text", (kept if groups else F.array().cast("array<string>")).alias("groups"))
    parts = F.array_sort(F.collect_list(F.struct("rule", kept.alias("g"))))
    return rows.groupBy("path", "ord", "match_no", "line", "column", "match_text").agg(parts.alias("p")) \
        .select("path", "ord", "line", "column", "match_text", F.flatten(F.transform("p", lambda x: x["g"])).alias("groups"))


CALL_RULES = (Rule(r"\b([a-zA-Z_]\w*)\s*\("), Rule(r"\.([a-zA-Z_]\w*)\s*\("),
              Rule(r"->([a-zA-Z_]\w*)\s*\("), Rule(r"::([a-zA-Z_]\w*)\s*\("))


#: Statements that call without a bracket, after the four patterns; one with a bracket is found by those.
CALL_STATEMENT = Rule(r"(?i)\bCALL\s+([a-zA-Z_]\w*+)(?!\s*\()")
PERFORM_STATEMENT = Rule(r"(?i)\b(?:PERFORM|CALL|INVOKE|GO\s+TO)\s+['\"]?([A-Z0-9][-A-Z0-9]*+)(?!\s*\()")


def call_sites(files: DataFrame) -> DataFrame:
    """Call-site index: four patterns in one pass; member calls appear under two of them.  Languages with call statements have a fifth."""
    corpus, keys = grep_corpus(files), ["path", "ord"]
    bracket = F.contains("content", F.lit("("))
    if "language" in files.columns:
        sets = ((0, (), CALL_RULES), (0, ("tal", "sql"), (*CALL_RULES, CALL_STATEMENT)), (0, ("cobol",), (*CALL_RULES, PERFORM_STATEMENT)))
        rows = match_rows_by(corpus.filter(bracket | F.col("language").isin("tal", "sql", "cobol")), keys, "content", "language", sets)
    else:
        rows = match_rows(corpus.filter(bracket), keys, "content", CALL_RULES)
    skip = (F.col("rule") == len(CALL_RULES)) & F.lower("g1").isin(*[w.lower() for w in grammar.CALL_RULES["cobol"][1]])
    return rows.filter(~F.col("g1").isin(*fixed.CALL_INDEX_KEYWORDS) & (F.length("g1") >= 2) & ~skip) \
        .select(F.col("g1").alias("fn"), "path", "ord", "rule", "match_no", "line", "column", "match_text")


def looks_like_definition(context: Column, name: Column) -> Column:
    n = escape_regex(name)
    return (F.rlike(context, F.concat(F.lit(r"^\s*(?:static\s+)?(?:inline\s+)?(?:\w+\s+\*?\s*)"), n, F.lit(r"\s*\(")))
            | F.rlike(context, F.concat(F.lit(r"^\s*\w+[\s\*]+"), n, F.lit(r"\s*\([^)]*\)\s*;")))
            | F.rlike(context, F.concat(F.lit(r"^\s*(?:void|int|char|bool|float|double|\w+)\s+"), n, F.lit(r"\s*\("))))


def search_calls(files: DataFrame, name: str, include_definitions=False,
                 max_results=None, file_pattern=None, sites=None) -> DataFrame:
    """Call sites of one function with context, lines that read like definitions dropped."""
    found = (call_sites(files.filter(F.contains("content", F.lit(name)))) if sites is None else sites).filter(F.col("fn") == name)
    if file_pattern is not None:
        found = found.filter(paths.matches_file_pattern(F.col("path"), file_pattern))
    found = attach_lines(found, grep_corpus(files)).withColumn("context", F.trim("match_line"))
    if not include_definitions:
        found = found.filter(~looks_like_definition(F.col("context"), F.lit(name)))
    found = found.select("fn", "path", "ord", "rule", "match_no", "line", "column", "match_text", "match_line",
                         "context", "before", "after")
    return found if max_results is None else ordering.top(found, ("ord", "rule", "match_no"), max_results)


def symbol_usages(files: DataFrame, name: str, max_results=None) -> DataFrame:
    """Calls, then whole-word references on lines without a call; one row per line."""
    calls = search_calls(files, name, max_results=max_results).select(
        "path", "ord", "line", "column", "match_line", "match_text", F.lit("call").alias("usage_type"),
        F.lit(0).alias("leg"), F.struct("ord", "rule", "match_no").alias("__o"))
    refs = search_literal(files, name, whole_word=True, max_results=max_results).select(
        "path", "ord", "line", "column", "match_line", "match_text", F.lit("reference").alias("usage_type"),
        F.lit(1).alias("leg"), F.struct("ord", F.col("line").alias("rule"), F.col("column").alias("match_no")).alias("__o"))
    if max_results is not None:
        room = calls.agg(F.greatest(F.lit(max_results) - F.count("*"), F.lit(0))).scalar()
        w = Window.orderBy("ord", "line", "column")  # at most max_results rows reach it
        refs = refs.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= room).drop("__n")
    rows = ordering.first_by(calls.unionByName(refs), ["path", "line"], ["leg", "__o"])
    return (rows if max_results is None else ordering.top(rows, ("leg", "__o"), max_results)).drop("__o")


def most_called(sites: DataFrame, limit=50) -> DataFrame:
    counts = sites.groupBy("fn").agg(F.count("*").alias("call_count"),
                                     F.min(F.struct("ord", "rule", "match_no")).alias("__first"))
    return ordering.top(counts, (F.desc("call_count"), "__first"), limit).drop("__first")


# Pattern and group of the name.
ENCLOSING_PATTERNS = (
    (r"^[\s]*(?:static\s+)?(?:inline\s+)?(\w+(?:\s*\*)*)\s+(\w+)\s*\([^)]*\)\s*\{?\s*$", 2),
    (r"^[\s]*def\s+(\w+)\s*\(", 1),
    (r"^[\s]*(?:async\s+)?function\s+(\w+)\s*\(", 1),
    (r"^[\s]*(?:public|private|protected)?\s*(?:static\s+)?(\w+)\s+(\w+)\s*\(", 2),
)


def definition_name(line: Column) -> Column:
    """Name when a line reads like a function definition, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, g), F.lit("")) for p, g in ENCLOSING_PATTERNS])


def enclosing_functions(hits: DataFrame, files: DataFrame, reach=100) -> DataFrame:
    """Backward as-of join: the nearest definition-looking line at or above each hit.

    Hits and definition lines are merged per file and swept once, so a file with many
    of both costs a sort, not a product.
    """
    defs = corpus_lines(files).withColumn("name", definition_name(F.col("text"))).filter("name is not null") \
        .select("path", "line", F.lit(0).alias("is_hit"),
                F.struct("name", "line", F.trim("text").alias("signature")).alias("fn"), F.lit(None).alias("hit"))
    cols = [c for c in hits.columns if c not in ("path", "line")]
    events = hits.select("path", "line", F.lit(1).alias("is_hit"),
                         F.lit(None).cast(defs.schema["fn"].dataType).alias("fn"), F.struct(*cols).alias("hit"))
    defs = defs.withColumn("hit", F.lit(None).cast(events.schema["hit"].dataType))
    w = Window.partitionBy("path").orderBy("line", "is_hit").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(defs).withColumn("near", F.last("fn", ignorenulls=True).over(w)).filter("is_hit = 1")
    near = F.when(F.col("line") - F.col("near.line") < reach, F.col("near"))
    return swept.select("path", "line", "hit.*", near["name"].alias("enclosing_name"),
                        near["line"].alias("enclosing_line"), near["signature"].alias("enclosing_signature"))


def search_with_function(files: DataFrame, pattern: str, **options) -> DataFrame:
    return enclosing_functions(search_literal(files, pattern, **options), grep_corpus(files))


def any_term_lines(lines: DataFrame, query_terms, limit=None) -> DataFrame:
    """Lines holding any of a query's terms, in file order."""
    cond = F.lit(False)
    for t in query_terms:
        cond = cond | F.contains(F.lower("text"), F.lit(t.lower()))
    found = lines.filter(cond)
    return found if limit is None else ordering.top(found, ("ord", "line"), limit)


def keyword_search(files: DataFrame, keywords, per_keyword: int, limit: int) -> DataFrame:
    """The first hits of each keyword, first hit per line kept, in keyword order; one scan for all keywords."""
    legs = search_literals(files, keywords, per_keyword, context_lines=2)
    rows = ordering.first_by(legs, ["path", "line"], ["leg", "ord", "column"])
    return ordering.top(rows, ("leg", "ord", "line"), limit)


def grep_stats(files: DataFrame, sites: DataFrame = None) -> DataFrame:
    corpus = grep_corpus(files)
    base = corpus.agg(F.count("*").alias("files"), F.sum(line_count(F.col("content"))).alias("total_lines"),
                      F.sum(F.length("content")).alias("total_chars"))
    sites = call_sites(files) if sites is None else sites
    by_name = sites.groupBy("fn").agg(F.count("*").alias("n"))
    return base.select("*", by_name.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().alias("indexed_calls"),
                       by_name.agg(F.count("*")).scalar().alias("unique_functions"))
