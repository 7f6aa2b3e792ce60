"""Scoped search: score files by text hits, vectors, index hits, siblings and names; select; filter."""

from pyspark.sql import DataFrame, functions as F

from ..functions import classify, fixed, paths, text
from ..operators import grep, joins, ordering, rank, topk


def parse_query(spark, query: str):
    return list(text.evaluate(spark, text.scope_terms(F.lit(query))))


def text_scores(files: DataFrame, terms, max_hits=None, extensions=fixed.SCOPE_CODE_EXTENSIONS) -> DataFrame:
    """Fold of term scores per file: the first term sets the score, each later one adds 15.

    A phrase without hits is searched by its words; files first found that way earn 25 when
    all words hit and 10 when more than one does.  All terms and words share one scan;
    ``max_hits`` counts the first hits of each in file order only.
    """
    legs = [(t, 65 if " " in t else 50, None, None) for t in terms]
    for i, t in enumerate(terms):
        legs += [(w, 55, t, i) for w in t.split() if " " in t and len(w) >= 2]
    of = lambda k, kind: F.get(F.array(*[F.lit(leg[k]).cast(kind) for leg in legs]), F.col("leg"))
    hits = grep.search_literals(files, [leg[0] for leg in legs], max_hits)
    if extensions is not None:
        hits = hits.filter(paths.bare_extension(F.col("path")).isin(*extensions))
    counted = hits.groupBy("leg", "path").agg(F.count("*").alias("hits")).withColumn("needs", of(3, "int"))
    if any(leg[3] is not None for leg in legs):
        met = counted.filter("needs is null").agg(F.collect_set("leg")).scalar()
        counted = counted.filter(F.col("needs").isNull() | ~F.array_contains(met, F.col("needs")))
    events = counted.select("path", F.col("leg").alias("place"), of(0, "string").alias("term"), of(2, "string").alias("phrase"), "hits",
                            rank.js_round(of(1, "int") + F.log2(F.col("hits") + 1) * 6).alias("s"))
    per_file = events.groupBy("path").agg(  # one entry per query term
        F.array_sort(F.collect_list(F.struct("place", "s", "hits", "phrase", "term"))).alias("e"))
    score = F.aggregate("e", F.lit(0).cast("bigint"), lambda s, x: F.when(s == 0, x["s"]).otherwise(F.greatest(s, x["s"]) + 15))
    hits = F.aggregate("e", F.lit(0).cast("bigint"), lambda s, x: s + x["hits"])
    first_phrase = F.get("e", F.lit(0))["phrase"]
    words = F.size(F.filter(F.split(first_phrase, " "), lambda w: F.length(w) >= 2))
    matched = F.size(F.array_distinct(F.transform(F.filter("e", lambda x: x["phrase"].isNotNull()), lambda x: x["term"])))
    bonus = F.when(first_phrase.isNull(), 0).when(matched == words, 25).when(matched > 1, 10).otherwise(0)
    return per_file.select("path", (score + bonus).alias("score"), hits.alias("grep_matches"))


def merge(found: DataFrame, more: DataFrame, bonus: int, source: str) -> DataFrame:
    """Full merge of a further leg: files in both keep the larger score plus a bonus."""
    m = more.select("path", F.col("score").cast("bigint").alias("__s"))
    both = F.col("score").isNotNull() & F.col("__s").isNotNull()
    return found.join(m, "path", "full").withColumn(
        "source", F.when(both, F.concat("source", F.lit("+" + source))).otherwise(F.coalesce("source", F.lit(source)))) \
        .withColumn("score", F.when(both, F.greatest("score", "__s") + bonus).otherwise(F.coalesce("score", "__s"))) \
        .drop("__s")


def name_bonus(path, terms):
    stem = paths.stem_name(path)
    total = F.lit(0)
    for t in terms:
        total = total + F.when(stem == t, 50).when(F.startswith(stem, F.lit(t)), 30).when(F.contains(stem, F.lit(t)), 15).otherwise(0)
    return total


def matching_files(files: DataFrame, query: str, near: DataFrame = None, found_docs: DataFrame = None, symbols: DataFrame = None,
                   max_results=50, keyword_fallback=True, **options) -> DataFrame:
    """Ranked files of a scope query, with the threshold selection flag.

    ``near``: chunk similarities (file, similarity); ``found_docs``: index hits (file, score).
    """
    terms = parse_query(files.sparkSession, query)
    found = text_scores(files, terms, **options).withColumn("source", F.lit("grep")).withColumn("score", F.col("score").cast("bigint"))
    if near is not None:
        found = merge(found, rank.files_by_vectors(near, max_results * 2).withColumnRenamed("file", "path"), 10, "vector")
    if found_docs is not None:
        found = merge(found, rank.files_by_index(found_docs, max_results * 2).withColumnRenamed("file", "path"), 20, "inverted")
    none_found = found.agg(F.count("*")).scalar() == 0
    beside = joins.siblings(files, found, terms).select("path", F.col("score").cast("bigint").alias("score"),
                                                        F.lit(None).cast("bigint").alias("grep_matches"), F.lit("sibling").alias("source"))
    out = found.select("path", "score", "grep_matches", "source").unionByName(beside.filter(~none_found))
    out = out.join(files.select("path", "ord"), "path").withColumn("score", F.col("score") + name_bonus(F.col("path"), terms))
    if keyword_fallback:
        plain = rank.keyword_files(files, symbols, terms, max_results).select(
            "path", F.col("score").cast("bigint").alias("score"), F.lit(None).cast("bigint").alias("grep_matches"), F.lit("keyword").alias("source"), "ord")
        out = out.unionByName(plain.filter(none_found).select(out.columns))
    best = out.agg(F.max("score")).scalar()
    out = out.withColumn("selected", F.col("score") >= F.greatest(F.lit(30), best * 0.4))
    return ordering.top(out, (F.desc("score"), "ord"), max_results)


class Scope:
    """The active scope of a session: a query and a table of paths."""

    def __init__(self):
        self.query, self.paths = None, None

    @property
    def active(self):
        return self.paths is not None

    def activate(self, query, selected: DataFrame):
        self.query, self.paths = query, selected.select("path").distinct()

    def deactivate(self):
        self.query, self.paths = None, None

    def files(self, files: DataFrame) -> DataFrame:
        return joins.in_scope_by_suffix(files, self.paths) if self.active else files

    def filter(self, results: DataFrame, column="file") -> DataFrame:
        return joins.in_scope(results, self.paths, column) if self.active else results


def run_command(scope: Scope, message: str, files: DataFrame, **options):
    """Execute a scope command; returns the selected files for a search, the status for the rest."""
    spark = files.sparkSession
    cmd = text.evaluate(spark, classify.scope_command(F.lit(message)))
    if cmd["type"] is None:
        return None
    if cmd["type"] == "unscope":
        scope.deactivate()
    elif cmd["type"] == "search":
        found = matching_files(files, cmd["args"], **options)
        selected = topk.auto_select(found)
        scope.activate(cmd["args"], selected)
        return selected
    n = scope.paths.count() if scope.active else 0
    return spark.createDataFrame([(scope.active, scope.query, n)], "active boolean, query string, files bigint")


def select_paths(scope: Scope, query: str, chosen: DataFrame) -> bool:
    """Explicit selection; nothing chosen leaves the scope as it was."""
    if chosen.isEmpty():
        return False
    scope.activate(query, chosen)
    return True
