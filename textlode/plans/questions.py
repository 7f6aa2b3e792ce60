"""Many questions at once: one table of (question, query) meets the index tables in one join per leg.

Scans and shuffles follow the index, not the number of questions or of their terms: terms are rows that join symbol names, symbol trigrams, file names,
directory names, positional gram postings and term postings.  A symbol keeps the first leg that found it; the only cut is each question's final top-k.

Every join says which side is sent to all tasks: rows of the questions.  Sides that grow with the index are merged (``ordering.apart``), as Spark, which
does not know how few rows the questions are, would send the index's side through the driver.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text
from ..operators import index, joins, ordering, rank

LEGS = ("concept_file", "exact_match", "pattern_match", "directory_match", "trigram_code", "inverted_index", "summary_search", "file_keyword")


def query_terms(questions: DataFrame) -> DataFrame:
    """(question, term, no, extra): the search terms of each query in order, then the compounds they form with its action verbs (``extra``)."""
    asked = questions.select("question", F.col("query").alias("q"), text.without_stop_words(text.search_terms(F.col("query"))).alias("t"))
    asked = asked.select("question", "t", text.compound_terms(F.col("q"), F.col("t")).alias("e"))
    every = F.array_distinct(F.concat("t", "e"))
    return asked.select("question", "e", "t", F.posexplode(every).alias("no", "term")).select(
        "question", "term", "no", F.array_contains("e", F.col("term")).alias("extra"), F.array_contains("t", F.col("term")).alias("own"))


def _leg(found: DataFrame, leg: int, a, b, score, source) -> DataFrame:
    """One leg's rows (question, key, leg, place, match_score, match_source) from rows with question, key and ord."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return found.select("question", "key", F.lit(leg).alias("leg"), F.struct(column(a).cast("double").alias("a"), column(b).cast("double").alias("b"), F.col("ord").alias("o")).alias("place"),
                        column(score).cast("double").alias("match_score"), column(source).alias("match_source"))


def concept_files(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(question, path, ord, match_score): files named after a term or its singular, 100 for the name or its plural, 90 for a near prefix.

    A near prefix leaves less than eight characters, so a name has eight prefixes to look up.
    """
    forms = terms.filter(F.length("term") >= 3).select("question", "no", F.posexplode(F.array_distinct(F.array("term", text.concept_singular(F.col("term"))))).alias("i", "form"))
    n = F.length("stem")
    names = files.select("path", "ord", paths.stem_name(F.col("path")).alias("stem")).filter(n >= 1)
    names = names.select("path", "ord", "stem", F.explode(F.sequence(F.greatest(n - 7, F.lit(1)), n)).alias("k")).withColumn("form", F.left("stem", F.col("k")))
    score = F.when((F.col("stem") == F.col("form")) | (F.col("stem") == F.concat("form", F.lit("s"))), 100).otherwise(90)
    each = names.join(F.broadcast(forms), "form").groupBy("question", "no", "path", "ord").agg(F.min_by(score, "i").alias("s"))
    return each.groupBy("question", "path", "ord").agg(F.max("s").alias("match_score"))


def pattern_symbols(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, ord, match_score): names that hold every trigram of a term and score 30 or more; terms of under three letters or digits are substrings."""
    wanted = terms.select("term").filter(F.length("term") >= 3).distinct()
    grams = wanted.select("term", F.array_distinct(text.alnum_trigrams(F.col("term"))).alias("g")).filter(F.size("g") > 0)
    grams = grams.select("term", F.size("g").alias("n"), F.explode("g").alias("tri"))
    both = index.symbol_trigrams(symbols).join(F.broadcast(grams), "tri").groupBy("term", "n", "key").agg(F.count("*").alias("k")).filter(F.col("k") == F.col("n"))
    named = symbols.select("key", "ord", F.lower("name").alias("low"))
    long = named.join(ordering.apart(both.select("term", "key")), "key").withColumn("match_score", text.name_score(F.col("term"), F.col("low"))).filter("match_score >= 30")
    short = wanted.filter(F.length(text.alnum_only(F.col("term"))) < 3).withColumn("tri", F.left("term", F.lit(3)))
    raw = named.select("key", "ord", "low", F.explode(F.array_distinct(text.positioned_trigrams(F.col("low")))).alias("tri"))
    loose = raw.join(F.broadcast(short), "tri").filter(F.contains("low", F.col("term"))).withColumn("match_score", F.lit(50))
    cols = ["term", "key", "ord", "match_score"]
    return long.select(cols).unionByName(loose.select(cols))


def directory_files(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(question, path, ord, no): files under a directory whose base name contains a term or stands in one; ``no``: the first such term.

    Base names and terms are short, so both ways are equi-joins on their substrings.
    """
    dirs = index.directories(files).withColumn("base", F.lower(F.substring_index("dir", "/", -1)))
    bases = dirs.select("base").filter(F.length("base") > 0).distinct()
    words = terms.select("term").distinct()

    def parts(df, column):  # all substrings
        n = F.length(column)
        cut = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(column, i, k))))
        return df.filter(n > 0).select(column, F.explode(F.array_distinct(cut)).alias("part"))

    inside = parts(bases, "base").select("base", F.col("part").alias("term")).join(F.broadcast(words), "term")
    around = F.broadcast(parts(words, "term").select("term", F.col("part").alias("base"))).join(bases, "base")
    pairs = inside.select("base", "term").unionByName(around.select("base", "term")).distinct()
    found = dirs.join(ordering.apart(pairs), "base").join(F.broadcast(terms.select("question", "term", "no")), "term")
    return found.groupBy("question", "path", "ord").agg(F.min("no").alias("no"))


def code_lines(grams: DataFrame, starts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, path, line) of the lines that contain a term of three letters or digits or more, from positional postings."""
    wanted = terms.filter(F.length(text.alnum_only(F.col("term"))) >= 3).select("term").distinct()
    offsets = rank.literal_offsets(grams, wanted)
    lines = offsets.join(ordering.apart(starts), "path").select("term", "path", F.explode(F.array_distinct(F.transform(
        "offsets", lambda o: F.size(F.filter("starts", lambda s: s <= o))))).alias("line"))
    return lines


def document_hits(docs: DataFrame, posts: DataFrame, questions: DataFrame, min_score=0.1) -> DataFrame:
    """(question, doc_id, doc_type, score): TF-IDF scores of every document for every question; one join of the questions' tokens with the postings."""
    tokens = F.array_distinct(text.learner_tokens(F.col("query")))
    asked = questions.select("question", F.size(tokens).alias("size"), F.explode(tokens).alias("term"))
    n_docs = docs.agg(F.count("*")).scalar()
    held = posts.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    dfs = held.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    scored = held.join(F.broadcast(dfs), "term").join(F.broadcast(asked), "term")
    totals = scored.groupBy("question", "size", "doc_id", "doc_type").agg(F.sum(rank.tfidf(F.col("freq"), n_docs, F.col("df")) * (1 + F.log1p(F.lit(1.0)) * 0.1)).alias("total"), F.count("*").alias("matched"))
    return totals.filter(F.col("total") >= min_score).select("question", "doc_id", "doc_type", (F.col("total") * (1 + F.col("matched") / F.col("size"))).alias("score"))


def search_questions(ix, questions: DataFrame, max_results=None, search_types=("all",)) -> tuple[DataFrame, DataFrame]:
    """(symbols, files) of many questions over eight legs in fixed priority.

    ``questions``: (question, query), and ``most`` where questions have limits of their own.  Symbols: (question, rank, key, match_score, match_source,
    leg, place), each question's best ``max_results`` (None: all); files: (question, path, leg, place, match_score, match_source, ord), all.
    """
    use = lambda kind: "all" in search_types or kind in search_types
    terms = ordering.cut_lineage(query_terms(questions))
    own = terms.filter("own")
    sym = ix.symbols
    keyed = sym.select("key", "ord", F.col("file").alias("path"))
    legs, file_legs = [], []

    def files_leg(found, leg, place, score, source):
        file_legs.append(found.select("question", "path", F.lit(leg).alias("leg"), place.cast("double").alias("place"), score.cast("double").alias("match_score"),
                                      source.alias("match_source"), "ord"))

    def with_symbols(found):
        return keyed.join(ordering.apart(found.drop("ord")), "path")

    if use("files"):
        concept = ordering.cut_lineage(concept_files(ix.files, own))
        files_leg(concept, 0, -F.col("match_score"), F.col("match_score"), F.when(F.col("match_score") == 100, "concept_exact").otherwise("concept_prefix"))
        legs.append(_leg(with_symbols(concept), 0, -F.col("match_score"), 0, 95, LEGS[0]))
        dirs = directory_files(ix.files, own).join(ordering.apart(concept.select("question", "path")), ["question", "path"], "left_anti")
        files_leg(dirs, 1, F.col("no"), F.lit(85), F.lit(LEGS[3]))
        legs.append(_leg(with_symbols(dirs), 3, F.col("no"), 0, 75, LEGS[3]))
    if use("symbols"):
        exact = sym.select("key", "ord", F.lower("name").alias("term")).join(F.broadcast(terms), "term")
        legs.append(_leg(exact, 1, F.col("no"), 0, F.when(F.col("extra"), 98).otherwise(100), F.when(F.col("extra"), "expanded_match").otherwise(LEGS[1])))
        pattern = pattern_symbols(sym, terms).join(F.broadcast(terms.select("question", "term", "no")), "term")
        legs.append(_leg(pattern, 2, F.col("no"), -F.col("match_score"), F.col("match_score"), LEGS[2]))
    if use("code"):
        lines = code_lines(ix.gram_table, ix.line_table, own)
        near = joins.symbols_near(lines, sym, 50).select("term", "symbol.key", "symbol.ord").distinct()
        legs.append(_leg(near.join(F.broadcast(own), "term"), 4, F.col("no"), 0, 70, LEGS[4]))
    if use("symbols") or use("summaries") or use("files"):
        posts = ix.postings if ix.postings is not None else index.postings(ix.docs)
        hits = document_hits(ix.docs, posts, questions).join(ordering.apart(ix.docs.select("doc_id", "key", "path", F.col("doc_ord"))), "doc_id")
        hits = ordering.cut_lineage(hits.drop("doc_id"))
        of = lambda *kinds: hits.filter(F.col("doc_type").isin(*kinds))
        for kind, leg, types, factor in (("symbols", 5, ("symbol", "function"), 80), ("summaries", 6, ("summary",), 75)):
            if use(kind):
                legs.append(_leg(of(*types).drop("path").join(ordering.apart(keyed.drop("path")), "key"), leg, -F.col("score"), 0, F.col("score") * factor, LEGS[leg]))
        if use("files"):
            found = of("file", "code").select("question", "path", "score", F.col("doc_ord").alias("ord"))
            files_leg(found, 2, -F.col("score"), F.col("score") * 60, F.lit(LEGS[7]))
            legs.append(_leg(with_symbols(found), 7, -F.col("score"), 0, F.col("score") * 50, LEGS[7]))

    first = reduce(DataFrame.unionByName, legs).groupBy("question", "key").agg(
        F.min_by(F.struct("leg", "place", "match_score", "match_source"), F.struct("leg", "place")).alias("w")).select("question", "key", "w.*")
    most = F.lit(None).cast("int") if max_results is None else F.lit(max_results)
    if "most" in questions.columns:
        first, most = first.join(F.broadcast(questions.select("question", "most")), "question"), F.coalesce("most", most)
    number = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("match_score"), "leg", "place"))
    best = first.withColumn("rank", number).filter(most.isNull() | (F.col("rank") <= most)).drop("most")
    files = None
    if file_legs:
        one = F.min_by(F.struct("leg", "place", "match_score", "match_source", "ord"), F.struct("leg", "place", "ord")).alias("w")
        files = reduce(DataFrame.unionByName, file_legs).groupBy("question", "path").agg(one).select("question", "path", "w.*")
    return best, files


def asked(spark, queries) -> DataFrame:
    """A table of questions from (query) or (query, most), numbered from 0."""
    rows = [(i, *(q if isinstance(q, tuple) else (q, None))) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "question int, query string, most int")


def first_question(found: DataFrame, symbols: DataFrame, keys=("name", "file")) -> DataFrame:
    """Symbols of the first question that found them, one row for each of ``keys``."""
    rows = found.select("key", "question", "rank", "match_score", "match_source").join(ordering.apart(symbols), "key")
    return ordering.first_by(rows, list(keys), ["question", "rank"])


def fuzzy(symbols: DataFrame, questions: DataFrame, min_score=25, top=20) -> DataFrame:
    """(question, key, match_score): the ``top`` distinct names that are fuzzily like each query; one pass over the names for all questions in blocks."""
    firsts = ordering.first_by(symbols, ["name"], ["ord"])
    block = questions.agg(F.collect_list(F.struct("question", F.lower("query").alias("q")))).scalar()  # the stated questions
    each = firsts.select("key", "name", "ord", F.explode(block).alias("a")).withColumn("match_score", text.fuzzy_score(F.col("a.q"), F.col("name")))
    kept = each.filter(F.col("match_score") >= min_score).select(F.col("a.question").alias("question"), "key", "ord", "match_score")
    return ordering.top_per_key(kept, ["question"], [F.desc("match_score"), "ord"], top).drop("rn", "ord")


def kinds(questions: DataFrame) -> DataFrame:
    """(question, query, intent, target, variants) of each question."""
    from ..functions import classify
    return questions.select("question", "query", classify.intent(F.col("query")).alias("c")).select("question", "query", "c.intent", "c.target", "c.variants")


def callers(edges: DataFrame, asked_kinds: DataFrame, definitions: DataFrame) -> DataFrame:
    """(question, intent, side, name, key, file, type, line): callers and callees that the questions ask for; two joins for all questions."""
    wanted = asked_kinds.filter(F.col("intent").isin("callers", "callees", "explain")).select("question", "intent", F.explode("variants").alias("variant"))
    in_ = F.broadcast(wanted.filter(F.col("intent") != "callees")).join(edges, F.col("variant") == F.col("callee")).select("question", "intent", F.lit("caller").alias("side"), F.col("caller").alias("name"))
    out = F.broadcast(wanted.filter(F.col("intent") != "callers")).join(edges, F.col("variant") == F.col("caller")).select("question", "intent", F.lit("callee").alias("side"), F.col("callee").alias("name"))
    return in_.unionByName(out).distinct().join(ordering.apart(definitions.select("name", "key", "file", "type", "line")), "name", "left")


_PART = ("question", "part", "place", "key", "name", "file", "line", "score", "source")


def _part(rows: DataFrame, part: str, **columns) -> DataFrame:
    kinds_ = dict(zip(_PART, ("int", "string", "bigint", "string", "string", "string", "int", "double", "string"), strict=True))
    given = {"question": F.col("question"), "part": F.lit(part), **columns}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds_[c]).alias(c) for c in _PART])


def enrichments(ix, asked_kinds: DataFrame) -> DataFrame:
    """Callers, callees and call sites that the questions' intents ask for, as parts; of a question's spellings the first with any answers."""
    from ..operators import grep, parse
    variants = asked_kinds.select("question", "intent", F.posexplode("variants").alias("no", "variant"))
    definitions = parse.first_definitions(ix.symbols).select("name", "key", "file", "line")
    edges = ix.edges

    def side(intents, part, end, other):
        found = F.broadcast(variants.filter(F.col("intent").isin(*intents))).join(edges, F.col("variant") == F.col(end)).select("question", "no", F.col(other).alias("name"), "variant")
        best = found.groupBy("question").agg(F.min("no").alias("no"))
        found = found.join(F.broadcast(best), ["question", "no"]).distinct().join(ordering.apart(definitions), "name", "left")
        return _part(found, part, name=F.col("name"), key=F.col("key"), file=F.col("file"), line=F.col("line"), source=F.col("variant"))

    wanted = variants.filter(F.col("intent") == "callers")
    sites = grep.call_sites(ix.files).join(F.broadcast(wanted), F.col("fn") == F.col("variant"))
    first = sites.groupBy("question").agg(F.min("no").alias("no"))
    sites = sites.join(F.broadcast(first), ["question", "no"])
    return (side(("callers", "explain"), "caller", "callee", "caller").unionByName(side(("callees", "explain"), "callee", "caller", "callee"))
            .unionByName(_part(sites, "call_site", name=F.col("fn"), file=F.col("path"), line=F.col("line"), source=F.col("variant"))))


def combined(ix, questions: DataFrame, max_results=100) -> DataFrame:
    """One table of typed parts (question, part, place, key, name, file, line, score, source) of each question.

    Parts are symbols of all spellings in the order of their rank, files, callers, callees and call sites by intent, and ``stat`` rows with the number of
    rows of each part.  A symbol belongs to the first spelling that found it.
    """
    asked_kinds = ordering.cut_lineage(kinds(questions))
    spelled = asked_kinds.select(F.col("question").alias("q"), F.posexplode("variants").alias("no", "query"))
    each = ordering.cut_lineage(spelled.withColumn("question", F.concat_ws(":", F.col("q").cast("string"), F.col("no").cast("string"))))
    found, files = search_questions(ix, each.select("question", "query"))
    own = each.select("question", "q", "no", "query")
    first = ordering.first_by(found.join(F.broadcast(own), "question").select("q", "key", "no", "match_score", "match_source"), ["q", "key"], ["no"])
    number = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("match_score"), "no", "key"))
    best = first.withColumn("place", number).filter(F.col("place") <= max_results).join(ordering.apart(ix.symbols.select("key", "name", "file", "line")), "key").withColumnRenamed("q", "question")
    symbols = _part(best, "symbol", place=F.col("place"), key=F.col("key"), name=F.col("name"), file=F.col("file"), line=F.col("line"), score=F.col("match_score"), source=F.col("match_source"))
    by_file = ordering.first_by(files.join(F.broadcast(own), "question").select("q", "path", "no", "leg", "match_score", "match_source"), ["q", "path"], ["no", "leg"]).withColumnRenamed("q", "question")
    parts = symbols.unionByName(_part(by_file, "file", file=F.col("path"), score=F.col("match_score"), source=F.col("match_source"))).unionByName(enrichments(ix, asked_kinds))
    parts = ordering.cut_lineage(parts)
    counts = parts.groupBy("question", F.col("part").alias("of")).agg(F.count("*").alias("n"))
    return parts.unionByName(_part(counts, "stat", name=F.col("of"), score=F.col("n")))
