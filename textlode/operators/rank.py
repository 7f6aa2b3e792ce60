"""Ranked retrieval over postings, vectors, symbols and file names."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, paths, text
from . import index, ordering


#: Grams that are named in a filter; more are joined.
MOST_PUSHED = 500


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def tfidf(freq, n_docs, df):
    return F.log1p(freq) * F.log(n_docs / (1 + df))


def query_terms(spark, query: str, stem_query=False):
    """Distinct query tokens; unstemmed unless asked, as the index lookup expects exact keys."""
    q = F.lit(query)
    if not stem_query:
        return list(text.evaluate(spark, F.array_distinct(text.learner_tokens(q))))
    words = F.filter(text.index_tokens(q), text.keeps_index_token)
    stems = F.filter(F.transform(words, text.stem), lambda s: F.length(s) >= 2)
    return list(text.evaluate(spark, F.array_distinct(stems)))


def search_documents(docs: DataFrame, query: str, max_results=50, min_score=0.1, doc_types=None,
                     stem_query=False, learned=None, extra_terms=(), posts: DataFrame = None) -> DataFrame:
    """TF-IDF document search.

    With ``posts`` (a stored posting table) only the query's terms are read; otherwise the
    corpus is scanned once and the term filter sits right behind the tokenizer.  Document
    frequencies count postings of every type, also when the result is restricted.
    """
    spark = docs.sparkSession
    wanted = list(dict.fromkeys(query_terms(spark, query, stem_query) + list(extra_terms)))
    if not wanted:
        return docs.limit(0).select("doc_id", "doc_type", F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"),
                                    F.lit(0).cast("bigint").alias("matched"))
    hits = index.postings(docs, only=wanted, learned=learned) if posts is None \
        else posts.filter(F.col("term").isin(*wanted))
    n_docs = docs.agg(F.count("*")).scalar()
    # one row per query term; reading tf here keeps this branch equal to the scoring branch
    # below its shuffle, so the corpus is tokenized once and the exchange is reused
    dfs = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    scored = hits.join(F.broadcast(dfs), "term")
    weight = F.lit(1.0)
    if learned is not None:
        scored = scored.join(F.broadcast(learned.filter(F.col("term").isin(*wanted)).select("term", "weight")),
                             "term", "left")
        weight = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    if doc_types is not None:
        scored = scored.filter(F.col("doc_type").isin(*doc_types))
    part = tfidf(F.col("freq"), n_docs, F.col("df")) * (1 + F.log1p(weight) * 0.1)
    totals = scored.groupBy("doc_id", "doc_type").agg(
        F.sum(part).alias("total"), F.count("*").alias("matched"), F.array_sort(F.collect_list("term")).alias("terms"))
    totals = totals.filter(F.col("total") >= min_score) \
        .withColumn("coverage", F.col("matched") / len(wanted)) \
        .withColumn("score", F.col("total") * (1 + F.col("coverage")))
    return ordering.top(totals.select("doc_id", "doc_type", "score", "coverage", "matched", "terms"),
                        (F.desc("score"), "doc_id"), max_results)


# --- vectors ----------------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector; sums in double."""
    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    den = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (den == 0), F.lit(0.0)).otherwise(dot / F.nullif(den, F.lit(0.0)))


def nearest_vectors(vectors: DataFrame, query_vector, k=10, threshold=fixed.SIMILARITY_THRESHOLD,
                    column="embedding", tie="ord") -> DataFrame:
    """Brute-force cosine top-k.  The query is a literal or a scalar subquery, never a join side."""
    scored = vectors.withColumn("__q", query_vector) \
        .withColumn("similarity", cosine(F.col(column), F.col("__q"))).drop("__q") \
        .filter(F.col("similarity") >= threshold)
    return ordering.top(scored, (F.desc("similarity"), tie), k)


def nearest_sparse(sparse: DataFrame, query_weights: DataFrame, key="id", k=10,
                   threshold=fixed.SIMILARITY_THRESHOLD, strict=False) -> DataFrame:
    """Cosine top-k on unit-length sparse vectors: only shared buckets meet.

    The query has at most one row per bucket, so it is broadcast at a fixed size.
    """
    dots = sparse.join(F.broadcast(query_weights.select("bucket", F.col("weight").alias("qw"))), "bucket") \
        .groupBy(key).agg(F.sum(F.col("weight") * F.col("qw")).alias("similarity"))
    near = dots.filter(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)
    return ordering.top(near, (F.desc("similarity"), key), k)


def files_by_vectors(near: DataFrame, max_results=40) -> DataFrame:
    """Chunk hits (already a bounded top-k) folded to files."""
    files = near.groupBy("file").agg(F.max("similarity").alias("similarity"), F.count("*").alias("match_count"))
    score = js_round(F.col("similarity") * 100) + F.least(F.col("match_count") * 2, F.lit(20))
    return ordering.top(files.withColumn("score", score), (F.desc("score"), "file"), max_results)


def files_by_index(found: DataFrame, max_results=40) -> DataFrame:
    """Document hits folded to files: capped best score plus a capped count bonus."""
    files = found.filter(F.col("file").isNotNull()).groupBy("file").agg(
        F.max("score").alias("best"), F.count("*").alias("match_count"))
    score = F.least(js_round(F.col("best") * 20), F.lit(100)) + F.least(F.col("match_count") * 3, F.lit(30))
    return ordering.top(files.withColumn("score", score), (F.desc("score"), "file"), max_results)


# --- symbols ----------------------------------------------------------------------

def symbols_by_pattern(symbols: DataFrame, pattern: str, max_results=50) -> DataFrame:
    """Names holding every trigram of the pattern and scoring 30 or more.

    All trigrams of the alnum-only pattern occur in the alnum-only name; that test runs
    on the row itself, so no posting join is needed.  Short patterns fall back to a
    substring test at score 50.
    """
    p = pattern.lower()
    alnum = "".join(c for c in p if c.isascii() and c.isalnum())
    name = F.lower("name")
    if len(alnum) < 3:
        found = symbols.filter(F.contains(name, F.lit(p))).withColumn("match_score", F.lit(50))
        return ordering.top(found, ("ord",), max_results)
    squeezed = text.alnum_only(F.col("name"))
    cond = F.lit(True)
    for tri in dict.fromkeys(alnum[i:i + 3] for i in range(len(alnum) - 2)):
        cond = cond & F.contains(squeezed, F.lit(tri))
    found = symbols.filter(cond).withColumn("match_score", text.name_score(F.lit(p), name)).filter("match_score >= 30")
    return ordering.top(found, (F.desc("match_score"), "ord"), max_results)


def symbols_by_trigram_postings(symbols: DataFrame, posts: DataFrame, pattern: str, max_results=50) -> DataFrame:
    """The same answer from a stored trigram table: intersect postings, then verify."""
    p = pattern.lower()
    alnum = "".join(c for c in p if c.isascii() and c.isalnum())
    tris = list(dict.fromkeys(alnum[i:i + 3] for i in range(len(alnum) - 2)))
    if not tris:
        return symbols_by_pattern(symbols, pattern, max_results)
    keys = posts.filter(F.col("tri").isin(*tris)).groupBy("key").agg(F.count("*").alias("n")) \
        .filter(F.col("n") == len(tris)).select("key")
    found = symbols.join(keys, "key", "left_semi") \
        .withColumn("match_score", text.name_score(F.lit(p), F.lower("name"))).filter("match_score >= 30")
    return ordering.top(found, (F.desc("match_score"), "ord"), max_results)


def fuzzy_symbols(symbols: DataFrame, query: str, kind=None, max_results=50, min_score=20) -> DataFrame:
    """Fuzzy search over distinct symbol names, first definition of each."""
    df = symbols if kind is None else symbols.filter(F.col("type") == kind)
    firsts = ordering.first_by(df, ["name"], ["ord"])
    scored = firsts.withColumn("match_score", text.fuzzy_score(F.lit(query.lower()), F.col("name"))) \
        .filter(F.col("match_score") >= min_score)
    return ordering.top(scored, (F.desc("match_score"), "ord"), max_results)


def _context(t: Column, width) -> Column:
    return F.trim(t) if width is None else F.left(F.trim(t), F.lit(width))


def find_text_in_code(lines: DataFrame, wanted: str, max_results=None, width=None) -> DataFrame:
    """Lines containing a text, verified after an all-trigram test on the same row; whole lines and all of them unless limits are given."""
    low = wanted.lower()
    alnum = "".join(c for c in low if c.isascii() and c.isalnum())
    if len(alnum) < 3:
        return lines.limit(0).select("path", "ord", "line", F.col("text").alias("context"))
    found = lines.filter((F.length("text") >= 3) & F.contains(F.lower("text"), F.lit(low)))
    found = found.select("path", "ord", "line", _context(F.col("text"), width).alias("context"))
    return found if max_results is None else ordering.top(found, ("ord", "line"), max_results)


def _matching_lines(files: DataFrame, low: str, per_file, width) -> DataFrame:
    first = (lambda a: a) if per_file is None else (lambda a: F.slice(a, 1, per_file))
    return files.filter((F.length("content") > 0) & F.contains(F.lower("content"), F.lit(low))) \
        .select("path", "ord", first(F.filter(
            F.transform(F.split("content", "\n", -1), lambda t, i: F.struct((i + 1).alias("line"), t.alias("t"))),
            lambda x: F.contains(F.lower(x["t"]), F.lit(low)))).alias("matches")) \
        .filter(F.size("matches") > 0) \
        .select("path", "ord", F.size("matches").alias("match_count"),
                F.transform("matches", lambda x: F.struct(x["line"].alias("line"), _context(x["t"], width).alias("context"))).alias("matches"))


def trigram_file_search(files: DataFrame, query: str, max_results=100, per_file=None, width=None, posts: DataFrame = None) -> DataFrame:
    """Files with verified substring lines, by number of lines; ``per_file`` keeps the first lines of each, ``width`` the first characters of a line.

    With ``posts`` (stored positional postings) only the query's grams are read, and then only the files in which they stand in a row; without them all
    texts are scanned.
    """
    if len(query) < 3:
        return files.limit(0).select("path", F.lit(0).alias("match_count"))
    low = query.lower()
    if posts is not None:
        files = files.join(literal_offsets(posts, _one_term(files.sparkSession, low), "or").select("path").distinct(), "path", "left_semi")
    return ordering.top(_matching_lines(files, low, per_file, width), (F.desc("match_count"), "ord"), max_results)


def lines_by_postings(files: DataFrame, posts: DataFrame, wanted: str, max_results=None, width=None) -> DataFrame:
    """``find_text_in_code`` from stored positional postings: text is read of the files only in which the grams stand in a row."""
    low = wanted.lower()
    if len("".join(c for c in low if c.isascii() and c.isalnum())) < 3:
        return files.limit(0).select("path", "ord", F.lit(0).alias("line"), F.col("content").alias("context"))
    kept = files.join(literal_offsets(posts, _one_term(files.sparkSession, low), "or").select("path").distinct(), "path", "left_semi")
    found = _matching_lines(kept, low, None, width).select("path", "ord", F.explode("matches").alias("m")).select("path", "ord", "m.line", "m.context")
    return found if max_results is None else ordering.top(found, ("ord", "line"), max_results)


def _one_term(spark, low):
    return spark.range(1).select(F.lit(low).alias("term"))


def literal_offsets(posts: DataFrame, terms: DataFrame, blank="and") -> DataFrame:
    """(term, path, offsets): where the texts ``terms`` (term, lower case, three characters or more) start in each file, from positional postings.

    Every gram of a term gives the starts that its own places allow (its positions less its place in the term); the starts that all grams allow are the
    occurrences.  A term is a few grams long, so a file's rows are as many.  White-space grams are in no posting; a term of three blanks or more in a row
    may therefore have false starts, which a caller that reads the text verifies (``blank="or"``) and others leave out (``blank="and"``).
    """
    grams = terms.select("term", F.posexplode(text.positioned_trigrams(F.col("term"))).alias("j", "tri")).filter(~F.col("tri").rlike(rf"^{text.SPACE}+$"))
    if blank == "and":
        grams = grams.filter(~F.col("term").rlike(rf"{text.SPACE}{{3}}"))
    grams = grams.withColumn("n", F.count("*").over(Window.partitionBy("term")))
    # the literal list of a few grams reaches the scan of the postings as a pushed filter; many are a semi join
    wanted = grams.select("tri").distinct()
    few = wanted.limit(MOST_PUSHED + 1).toArrow().column("tri").to_pylist()
    read = posts.filter(F.col("tri").isin(*few)) if len(few) <= MOST_PUSHED else posts.join(F.broadcast(wanted), "tri", "left_semi")
    starts = read.join(F.broadcast(grams), "tri").select("term", "path", "n", F.transform("positions", lambda p: p - F.col("j")).alias("starts"))
    both = starts.groupBy("term", "path", "n").agg(F.collect_list("starts").alias("s")).filter(F.size("s") == F.col("n"))
    offsets = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0)), F.array_intersect)
    return both.select("term", "path", offsets.alias("offsets")).filter(F.size("offsets") > 0)


# --- files ------------------------------------------------------------------------

def concept_files(files: DataFrame, query_terms_) -> DataFrame:
    """Files named after a concept: 100 for the name itself (or its plural), 90 for a near prefix."""
    stem = paths.stem_name(F.col("path"))
    score = F.lit(0)
    for t in query_terms_:
        if len(t) < 3:
            continue
        forms = list(dict.fromkeys([t, py_concept_singular(t)]))
        # the first form that matches decides for this term
        s = F.lit(0)
        for f in reversed(forms):
            s = F.when((stem == f) | (stem == f + "s"), F.lit(100)) \
                .when(F.startswith(stem, F.lit(f)) & (F.length(stem) < len(f) + 8), F.lit(90)).otherwise(s)
        score = F.greatest(score, s)
    return files.withColumn("match_score", score).filter("match_score > 0") \
        .select("path", "ord", paths.file_name(F.col("path")).alias("name"), "match_score",
                F.when(F.col("match_score") == 100, "concept_exact").otherwise("concept_prefix").alias("match_source"))


def py_concept_singular(w):
    """Singular of one query word, on the driver (query text only)."""
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("es") and len(w) > 4:
        return w[:-2]
    return w[:-1] if w.endswith("s") and len(w) > 3 else w


def py_singular(w):
    if w.endswith("ies") and len(w) <= 4:
        return w[:-1] if len(w) > 3 else w
    return py_concept_singular(w)


def keyword_file_score(path: Column, terms) -> Column:
    """Sum over terms and singulars: name 100, prefix 60, contained 25, directory 15."""
    name, stem, low = F.lower(paths.file_name(path)), paths.stem_name(path), F.lower(path)
    score = F.lit(0)
    for t in terms:
        for f in dict.fromkeys([t, py_singular(t)]):
            score = score + F.when(stem == f, 100).when(F.startswith(stem, F.lit(f)), 60) \
                .when(F.contains(name, F.lit(f)), 25).otherwise(0) \
                + F.when(F.contains(low, F.lit(f"/{f}/")), 15).otherwise(0)
    return score


def keyword_files(files: DataFrame, symbols: DataFrame, terms, max_results=40, per_file=None) -> DataFrame:
    """Fallback ranking by path words and by the symbols of each file (the first ``per_file`` if given), capped at 200."""
    base = files.select("path", "ord", keyword_file_score(F.col("path"), terms).alias("score"))
    if symbols is not None:
        hit = F.lit(0)
        for t in terms:
            hit = hit + F.when(F.contains(F.lower("name"), F.lit(t))
                               | F.contains(F.lower("name"), F.lit(py_singular(t))), 2).otherwise(0)
        read = symbols if per_file is None else ordering.top_per_key(symbols, ["file"], ["ord"], per_file)
        extra = read.groupBy("file").agg(F.sum(hit).alias("extra"))
        base = base.join(extra.withColumnRenamed("file", "path"), "path", "left")
        base = base.withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0))).drop("extra")
    base = base.withColumn("score", F.least("score", F.lit(200))).filter("score > 0")
    return ordering.top(base.select("path", "ord", "score", (F.col("score") >= 50).alias("selected")),
                        (F.desc("score"), "ord"), max_results)


def workspace_file_score(path: Column, terms, is_pattern=None, in_filter=None) -> Column:
    is_pattern = F.lit(False) if is_pattern is None else is_pattern
    in_filter = F.lit(False) if in_filter is None else in_filter
    low, name = F.lower(path), F.lower(paths.file_name(path))
    ext = F.lower(paths.extension(path))
    score = F.lit(10)
    for t in terms:
        score = score + F.when(F.contains(name, F.lit(t)), 30).otherwise(0) \
            + F.when(F.contains(low, F.lit(t)), 10).otherwise(0)
    score = score + F.when(F.contains(low, F.lit("test")), 0).otherwise(10) + F.when(is_pattern, 25).otherwise(0)
    for part, points in (("/src/", 15), ("/service/", 20), ("/model/", 20), ("/domain/", 20), ("/handler/", 15),
                         ("/api/", 15), ("readme", -20)):
        score = score + F.when(F.contains(low, F.lit(part)), points).otherwise(0)
    for end in ("impl.java", "service.java"):
        score = score + F.when(F.endswith(name, F.lit(end)), 15).otherwise(0)
    docs = F.contains(low, F.lit("/docs/")) | F.contains(low, F.lit("/documentation/"))
    return (score + F.when(ext.isin(".java", ".py", ".js", ".ts", ".go", ".c", ".cpp", ".rs"), 20).otherwise(0)
            - F.when(ext.isin(".md", ".txt", ".html"), 15).otherwise(0) - F.when(docs, 30).otherwise(0)
            + F.when(in_filter, 50).otherwise(0))


# --- relevance of found items -------------------------------------------------------

def relevance(terms, name="name", file="file", summary="summary", signature="signature", kind="type",
              base="match_score") -> Column:
    """Relevance of one symbol to a query's terms from its file name, path, name, summary and signature."""
    nm, fl = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(file, F.lit("")))
    fname = F.substring_index(fl, "/", -1)
    stem = F.regexp_replace(fname, r"\.[^.]+$", "")
    summ, sig = F.lower(F.coalesce(summary, F.lit(""))), F.lower(F.coalesce(signature, F.lit("")))
    score = F.least(F.coalesce(base, F.lit(0)).cast("double"), F.lit(30.0))
    matched = F.lit(False)

    def add(cond, points):
        nonlocal score, matched
        score = score + F.when(cond, points).otherwise(0)
        matched = matched | cond

    for t in terms:
        lit = F.lit(t)
        in_file, in_name = F.contains(fname, lit), F.contains(nm, lit)
        tri_file, tri_name = text.trigram_similarity(lit, stem), text.trigram_similarity(lit, nm)
        add(in_file, 150)
        add(~in_file & (tri_file >= 0.4), F.floor(tri_file * 120))
        root = t[:-3] if len(t) > 4 else t
        if len(root) >= 4:
            add(F.contains(stem, F.lit(root)), 80)
        add(~in_file & F.contains(fl, lit), 40)
        add(nm == lit, 80)
        add((nm != lit) & in_name, F.when(nm.rlike(f"(^|_){t}(_|$)"), 60).otherwise(35))
        add(~in_name & (tri_name >= 0.5), F.floor(tri_name * 50))
        add(F.contains(summ, lit), 25)
        add(F.contains(sig, lit), 15)
    score = score + F.when(F.col(kind).isin(*fixed.TYPE_LIKE), 15).otherwise(0)
    return F.when(matched, score).otherwise(F.greatest(score * 0.3, F.lit(10.0)))


def group_by_file(found: DataFrame) -> DataFrame:
    """Per file: symbol count, score sum and distinct match sources (sources are a handful of tags)."""
    return found.groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(
        F.count("*").alias("symbol_count"), F.sum(F.coalesce("match_score", F.lit(0))).alias("total_match_score"),
        F.array_sort(F.collect_set("match_source")).alias("sources"))


def score_files(found: DataFrame, terms, per_file=None) -> DataFrame:
    """File heuristic: name 150 or trigram*120, 20 per matching symbol (of the first ``per_file`` if given), term multiplier."""
    first = found.withColumn("file", F.coalesce("file", F.lit("unknown")))
    first = first if per_file is None else ordering.top_per_key(first, ["file"], ["ord"], per_file)
    per_term = [F.count_if(F.contains(F.lower("name"), F.lit(t))).alias(f"__t{i}") for i, t in enumerate(terms)]
    groups = group_by_file(found)
    if terms:
        groups = groups.join(first.groupBy("file").agg(*per_term), "file", "left")
    fname = F.lower(F.substring_index("file", "/", -1))
    stem = F.regexp_replace(fname, r"\.[^.]+$", "")
    score, matched = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        n = F.coalesce(f"__t{i}", F.lit(0))
        tri = text.trigram_similarity(F.lit(t), stem)
        in_file = F.contains(fname, F.lit(t))
        near = tri >= 0.4
        score = score + F.when(in_file, 150).when(near, F.floor(tri * 120)).otherwise(0) + n * 20
        matched = matched + F.when(in_file | near | (n > 0), 1).otherwise(0)
    if len(terms) >= 2:
        score = F.when(matched >= 2, score * (1 + (matched - 1) * 0.3)).otherwise(score * 0.7)
    score = js_round(score + F.size("sources") * 10)
    return groups.select("file", score.alias("score"), "symbol_count", "sources")


def apply_file_scores(found: DataFrame, scored: DataFrame, terms) -> DataFrame:
    """Relevance per symbol: its file's score (50 when unknown) plus name and type bonuses."""
    bonus = F.lit(0)
    for t in terms:
        bonus = bonus + F.when(F.contains(F.lower("name"), F.lit(t)), 30).otherwise(0)
    bonus = bonus + F.when(F.col("type").isin(*fixed.TYPE_LIKE), 15).otherwise(0)
    file_score = F.coalesce("score", F.lit(50))
    return found.join(scored.select("file", "score"), "file", "left") \
        .withColumn("file_score", file_score).withColumn("relevance_score", file_score + bonus).drop("score")


def split_tiers(scored: DataFrame, most=25, high=70, medium=40) -> DataFrame:
    """Primary: relevant enough, or among the first ``most``; secondary: medium and up; the rest leaves.

    Only the first ``most`` rows need a rank, so they are taken as a top-k and marked by key.
    """
    order = (F.desc("relevance_score"), "ord")
    leaders = ordering.top(scored, order, most).select("key", F.lit(True).alias("__lead"))
    tier = F.when((F.col("relevance_score") >= high) | F.col("__lead"), "primary") \
        .when(F.col("relevance_score") >= medium, "secondary")
    return scored.join(F.broadcast(leaders), "key", "left").withColumn("tier", tier) \
        .filter("tier is not null").drop("__lead")


def boost_factors(query: Column, kind: Column) -> DataFrame:
    """Leg multipliers (sym, tri, vec, sum, file) for a query and its class."""
    def by(**kw):
        e = F.lit(1.0)
        for k, v in kw.items():
            e = F.when(kind == k, F.lit(v)).otherwise(e)
        return e

    def if_(pattern, factor):
        return F.when(query.rlike(f"(?i)(?:{pattern})"), F.lit(factor)).otherwise(F.lit(1.0))

    why, find = "concept|understand|how|why", "find|search|locate|where"
    return {
        "sym": by(overview=0.5, domain=1.5, specific=2.0) * if_(find, 1.2) * if_("function|method|class|struct", 1.5),
        "tri": by(domain=1.2, specific=1.5) * if_(find, 1.3),
        "vec": if_(why, 1.2) * F.lit(1.0),
        "sum": by(overview=2.5, domain=2.0, specific=0.8) * if_(why, 1.3),
        "file": by(overview=2.0) * if_("file|module|directory", 2.0),
    }
