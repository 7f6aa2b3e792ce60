"""Search plans over an indexed corpus.

Searches of symbols go through ``questions``: a plan's queries, spellings and keywords are rows of one table, so its
scans do not grow with them.  Text searches tag their rows with (leg, place), and the first leg that found a row keeps it.
"""

from dataclasses import dataclass
from functools import reduce
from typing import Optional

from pyspark.sql import DataFrame, functions as F

from ..functions import classify, fixed, paths, text
from ..operators import context, grep, graph, index, joins, ordering, parse, rank, topk
from . import questions


@dataclass
class CorpusIndex:
    """Tables of one corpus.  ``postings`` may be a stored table; without it terms are read from text."""
    files: DataFrame
    symbols: DataFrame
    docs: DataFrame
    calls: Optional[DataFrame] = None
    postings: Optional[DataFrame] = None
    grams: Optional[DataFrame] = None
    starts: Optional[DataFrame] = None

    @property
    def gram_table(self):
        """Positional gram postings of source files."""
        return self.grams if self.grams is not None else index.positioned_trigrams(self.source)

    @property
    def line_table(self):
        return self.starts if self.starts is not None else index.line_starts(self.source)

    @property
    def source(self):
        return self.files.filter(paths.is_source(F.col("language")))

    @property
    def lines(self):
        return grep.corpus_lines(self.source)

    @property
    def edges(self):
        return parse.call_edges(self.calls)


def build_index(files: DataFrame, only_code=True, root=None) -> CorpusIndex:
    """Parse a corpus once: symbol, call and posting tables are stored, the rest derives from them.

    They are Parquet tables under ``root`` (a new folder that all executors share; by default in the checkpoint folder):
    symbols sorted by name, calls by caller, postings by term, gram postings by gram, so a search reads the parts that can hold its terms, and a
    lost executor re-reads files instead of re-parsing the corpus.
    """
    at = lambda name: root and f"{root}/{name}"
    kept = files.filter(paths.should_index(F.col("path"))) if only_code else files
    symbols = ordering.stored(parse.symbol_table(parse.parse_symbols(kept)), "name", at("symbols"))
    calls = ordering.stored(parse.call_lists(symbols, kept), "caller", at("calls"))
    docs = index.document_feed(kept, symbols)
    posts = ordering.stored(index.postings(docs), "term", at("postings"))
    source = kept.filter(paths.is_source(F.col("language")))
    grams = ordering.stored(index.positioned_trigrams(source), "tri", at("grams"), ranges=False)
    return CorpusIndex(kept, symbols, docs, calls, posts, grams, ordering.stored(index.line_starts(source), "path", at("starts")))


def unified_search(ix: CorpusIndex, query: str, max_results=100, search_types=("all",)):
    """(symbols, files) of one query; ``questions.search_questions`` answers many at once."""
    best, files = questions.search_questions(ix, questions.asked(ix.files.sparkSession, [query]), max_results, search_types)
    symbols = ix.symbols.join(ordering.apart(best.drop("question", "rank")), "key")
    return symbols, None if files is None else files.drop("question")


def base_context(ix: CorpusIndex, query: str, variants, max_results=100, hits_per_variant=None, blocks=25):
    """Symbols over all spellings of a query, literal hits of all spellings, code blocks for the best symbols.

    All spellings are searched together; a symbol belongs to the first one that found it.
    """
    spark = ix.files.sparkSession
    found, _ = questions.search_questions(ix, questions.asked(spark, list(variants)))
    first = ordering.first_by(found.select("key", "question", "match_score", "match_source"), ["key"], ["question"])
    best = ordering.top(first, (F.desc("match_score"), "question", "key"), max_results)
    spelling = F.get(F.array(*[F.lit(v) for v in variants]), F.col("question"))
    symbols = ix.symbols.join(best.withColumn("matched_variant", spelling).withColumnRenamed("question", "variant_no"), "key")
    hits = grep.search_literals(ix.files, list(variants), per_term=hits_per_variant)
    lead = ordering.top(symbols, (F.desc("match_score"), "variant_no", "key"), blocks)
    return symbols, hits, context.code_blocks(topk.dedupe_blocks(lead, 20, blocks), ix.files)


def execute_search(ix: CorpusIndex, query: str, max_results=100) -> dict:
    """Intent, base context and the enrichments that the intent asks for."""
    spark = ix.files.sparkSession
    asked = text.evaluate(spark, classify.intent(F.lit(query)))
    kind, target, variants = asked["intent"], asked["target"], list(asked["variants"])
    symbols, hits, blocks = base_context(ix, query, variants, max_results)
    out = {"intent": kind, "target": target, "variants": variants, "symbols": symbols, "hits": hits, "blocks": blocks}
    definitions = parse.first_definitions(ix.symbols)
    if kind in ("callers", "explain"):
        out["callers"] = graph.find_callers(ix.edges, variants, definitions)
    if kind in ("callees", "explain"):
        out["callees"] = graph.find_callees(ix.edges, variants, definitions)
    if kind == "callers":
        out["call_sites"] = first_call_sites(grep.call_sites(ix.files), variants)
    out["context"] = context.search_text(symbols, query, kind, target)
    return out


def first_call_sites(sites: DataFrame, variants, most=30) -> DataFrame:
    """Call sites of the first spelling that has any."""
    order = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("fn"))
    hits = sites.filter(F.col("fn").isin(*variants)).withColumn("variant_no", order)
    best = hits.agg(F.min("variant_no")).scalar()
    return ordering.top(hits.filter(F.col("variant_no") == best), ("ord", "rule", "match_no"), most)


def code_search(ix: CorpusIndex, query: str, keywords, max_results=50, fuzzy=20, per_name=3):
    """Unified result, all symbols of files whose path holds a keyword, all symbols of the keywords' searches, fuzzy names; deduped.

    The query and its keywords are one table of questions, so keywords add rows, not plans.
    """
    words = [k for k in keywords if len(k) >= 3]
    asked = questions.asked(ix.files.sparkSession, [(query, max_results), *[(k, None) for k in words]])
    cols = ["key", "file", "name", "type", "line", "ord"]
    found, _ = questions.search_questions(ix, asked)
    found = found.join(ordering.apart(ix.symbols.select(cols)), "key")
    leg = F.when(F.col("question") == 0, 0).otherwise(F.col("question") + 1)
    legs = [found.select(*cols, leg.alias("leg"), F.when(F.col("question") == 0, F.col("match_score")).otherwise(0.0).alias("match_score"))]
    named = joins.paths_with_any(ix.files, [k for k in keywords if len(k) >= 4])
    by_path = ix.symbols.join(ordering.apart(named.select(F.col("path").alias("file"))), "file", "left_semi").filter(~text.is_garbage_symbol(F.col("name")))
    legs.append(by_path.select(*cols, F.lit(1).alias("leg"), F.lit(0.0).alias("match_score")))
    close = rank.fuzzy_symbols(ix.symbols, query, max_results=fuzzy, min_score=25)
    legs.append(close.select(*cols, F.lit(len(words) + 2).alias("leg"), F.col("match_score").cast("double").alias("match_score")))
    all_ = ordering.first_by(reduce(DataFrame.unionByName, legs), ["name", "file"], ["leg", "ord"])
    ranked = all_.withColumn("ord", F.struct(F.col("leg"), (-F.col("match_score")).alias("s"), F.col("ord").alias("o")))
    return ranked if per_name is None else topk.dedupe_symbols(ranked, per_name)


def direct_symbols(symbols: DataFrame, query: str, keywords, most=50) -> DataFrame:
    """Last resort: names or paths holding a keyword, or names the query itself contains."""
    q, name, file = F.lit(query.lower()), F.lower("name"), F.lower(F.coalesce("file", F.lit("")))
    cond = F.contains(q, name) | ((F.length(name) > 4) & F.contains(q, F.left(name, F.lit(4))))
    for k in keywords:
        cond = cond | F.contains(name, F.lit(k)) | F.contains(file, F.lit(k))
    return ordering.top(symbols.filter(cond), ("ord",), most)


def functionality_search(ix: CorpusIndex, query: str, extra_terms=(), business=False, scope: DataFrame = None, max_results=50, each=None) -> DataFrame:
    """Base search plus one search per business pattern and extra term (``each``: the most of one), limited to a scope; one table of questions."""
    asks = [(query, max_results)]
    if business:
        asks += [(f"{query} {p}", each) for p in fixed.BUSINESS_PATTERNS]
    asks += [(t, each) for t in extra_terms]
    found, _ = questions.search_questions(ix, questions.asked(ix.files.sparkSession, asks))
    rows = found.join(ordering.apart(ix.symbols.select("key", "file", "name", "type", "line", "ord")), "key") \
        .select("key", "file", "name", "type", "line", "ord", F.col("question").alias("leg"), "match_score")
    first = ordering.first_by(rows, ["name", "file"], ["leg", "ord"])
    if scope is None:
        return first
    kept = joins.in_scope_by_suffix(first.select(F.col("file").alias("path")).distinct(), scope)
    return first.join(ordering.apart(kept.select(F.col("path").alias("file"))), "file", "left_semi")


def topic_search(files: DataFrame, topic: str, max_results=100, per_leg=None) -> DataFrame:
    """Exact phrase, keywords with their call sites, then spelling variants; deduped and tiered.

    Every leg keeps all its hits, or its first ``per_leg``; the final top-k is the only other cut.
    """
    spark = files.sparkSession
    variants = list(text.evaluate(spark, text.topic_variants(F.lit(topic))))
    words = list(text.evaluate(spark, text.first_keywords(F.lit(topic), len(topic) + 1)))
    cols = ["path", "line", "column", "match_line", "match_text"]
    place = F.struct("leg", "ord", "line", "column").alias("ord")
    rows = [grep.search_literals(files, [topic, *words, *variants], per_term=per_leg).select(*cols, place)]
    if words:
        called = F.lit(False)
        for w in words:
            called = called | F.contains("content", F.lit(w))
        sites = grep.call_sites(files.filter(called)).filter(F.col("fn").isin(*words))
        asked = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("fn")).cast("int") - 1 + 1000
        near = grep.attach_lines(sites.withColumn("leg", asked), grep.grep_corpus(files)).withColumn("context", F.trim("match_line"))
        near = near.filter(~grep.looks_like_definition(F.col("context"), F.col("fn")))
        near = near if per_leg is None else ordering.top_per_key(near, ["leg"], ["ord", "rule", "match_no"], per_leg)
        rows.append(near.select(*cols, place))
    return topk.rank_hits(reduce(DataFrame.unionByName, rows), topic, max_results)


def planned_search(files: DataFrame, query: str, max_results=50) -> DataFrame:
    """Run a question's plan: usages, calls or symbol search; keywords when those find nothing."""
    spark = files.sparkSession
    plan = text.evaluate(spark, classify.search_plan(F.lit(query)))
    cols = ["path", "line", "column", "match_line", "match_text"]
    tagged = lambda df, i: df.select(*cols, F.struct(F.lit(i).alias("leg"), "ord", "line", "column").alias("ord"))
    name = plan["function_name"]
    primary = None
    if plan["type"] == "function_search" and name:
        if plan["is_usage"]:
            primary = tagged(grep.symbol_usages(files, name, max_results * 2), 0)
        else:
            calls = tagged(grep.search_calls(files, name, max_results=max_results * 2 if plan["is_call"] else 50), 0)
            primary = calls
            if not plan["is_call"]:
                words = tagged(grep.search_literal(files, name, whole_word=True, max_results=max_results * 2), 1)
                primary = calls.unionByName(words.filter(calls.agg(F.count("*")).scalar() == 0))
    if plan["keywords"]:
        legs = grep.search_literals(files, plan["keywords"], per_term=max_results * 2) \
            .select(*cols, F.struct((F.col("leg") + 10).alias("leg"), "ord", "line", "column").alias("ord"))
        fallback = ordering.top(legs, ("ord",), max_results * 2 + 29)
        rows = fallback if primary is None else primary.unionByName(fallback.filter(primary.agg(F.count("*")).scalar() == 0))
    else:
        rows = primary
    return topk.rank_hits(rows, name or " ".join(plan["keywords"]), max_results)


def index_statistics(ix: CorpusIndex) -> DataFrame:
    """One row of counts over files, symbols and text lines."""
    from ..operators import aggregates
    stats = aggregates.symbol_stats(ix.symbols, ix.calls)
    g = grep.grep_stats(ix.files)
    return stats.select("*", *[g.select(c).scalar().alias(f"grep_{c}") for c in ("files", "total_lines", "total_chars", "indexed_calls")])
