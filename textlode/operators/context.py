"""Report text from search results.  Every list rendered here is a bounded top-k."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, paths, text
from . import ordering, rank


def fence(lang: Column, body: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```\n"))


def context_language(path: Column) -> Column:
    """Language tag used in report fences: the extension table for code, else the extension."""
    return F.when(F.length(F.coalesce(path, F.lit(""))) == 0, F.lit("c")).otherwise(F.coalesce(
        F.when(F.contains(path, F.lit(".")), F.try_element_at(paths.lit_map(fixed.LANGUAGE_BY_EXTENSION), paths.bare_extension(path))),
        paths.bare_extension(path)))


def code_blocks(symbols: DataFrame, files: DataFrame, before=5, after=40) -> DataFrame:
    """Lines around each symbol: five before the definition to forty behind it."""
    lines = files.select(F.col("path").alias("file"), F.split("content", "\n", -1).alias("lines"))
    start = F.greatest(F.lit(0), F.col("line") - 1 - before)
    end = F.least(F.size("lines"), F.col("line") + after)
    return symbols.join(lines, "file").withColumn("start_line", start + 1).withColumn("end_line", end) \
        .withColumn("code", F.array_join(F.slice("lines", start + 1, F.greatest(end - start, F.lit(0))), "\n")).drop("lines")


def raw_context(hits: DataFrame, files: DataFrame, n=30) -> DataFrame:
    """Lines around a hit without a symbol: four before to n behind."""
    lines = files.select("path", F.split("content", "\n", -1).alias("lines"))
    start, end = F.greatest(F.lit(0), F.col("line") - 5), F.least(F.size("lines"), F.col("line") + n)
    return hits.join(lines, "path").withColumn("start_line", start + 1).withColumn("end_line", end) \
        .withColumn("code", F.array_join(F.slice("lines", start + 1, F.greatest(end - start, F.lit(0))), "\n")).drop("lines")


def symbol_text(kind="type", name="name", line="line", score="relevance_score", signature="signature", summary="summary",
                file="file", code=None) -> Column:
    lang = context_language(F.col(file))
    none = F.lit("")
    sig = F.coalesce(signature, none)
    summ = F.coalesce(summary, none)
    out = F.concat(
        F.lit("### "), F.col(kind), F.lit(": `"), F.col(name), F.lit("`\nLine: "), F.coalesce(line, F.lit(0)).cast("string"),
        F.when(F.coalesce(score, F.lit(0)) != 0, F.concat(F.lit(" | Relevance: "), F.round(score).cast("bigint").cast("string"))).otherwise(none),
        F.lit("\n"), F.when(sig != "", fence(lang, sig)).otherwise(none),
        F.when(summ != "", F.concat(F.lit("> "), summ, F.lit("\n"))).otherwise(none))
    if code is not None:
        body = F.coalesce(code, none)
        out = F.concat(out, F.when(body != "", fence(lang, text.first_lines(body, 80))).otherwise(none))
    return F.concat(out, F.lit("\n"))


def block_text(file="file", line="start_line", symbol="symbol", code="code", most=80) -> Column:
    label = F.coalesce(symbol, F.lit(""))
    return F.concat(
        F.lit("### Code: "), F.substring_index(file, "/", -1), F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"),
        F.when(label != "", F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"),
        fence(context_language(F.col(file)), text.first_lines(F.coalesce(code, F.lit("")), most)), F.lit("\n"))


def primary_context(primary: DataFrame, budget: int, limit=100) -> DataFrame:
    """Verbatim symbols under a character budget: files by total score, symbols by score inside.

    A symbol that no longer fits is skipped and later, smaller ones may still enter; the
    fold runs over the search's own result limit.
    """
    totals = primary.groupBy("file").agg(F.sum("relevance_score").alias("file_total"), F.min("ord").alias("file_first"))
    items = ordering.top(primary, (F.desc("relevance_score"), "ord"), limit).join(F.broadcast(totals), "file") \
        .withColumn("text", symbol_text())
    order = (F.desc("file_total"), "file_first", F.desc("relevance_score"), "ord")
    w = Window.orderBy(*order)
    rows = items.withColumn("n", F.row_number().over(w)).agg(
        F.array_sort(F.collect_list(F.struct("n", "file", "text"))).alias("rows"))
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("section"), F.lit("").alias("file"))

    def head(f):
        return F.concat(F.lit("\n## "), F.substring_index(f, "/", -1), F.lit("\nPath: `"), f, F.lit("`\n\n"))

    def step(s, r):
        other = r["file"] != s["file"]
        done = F.when(other & (F.length(s["section"]) > 100), F.concat(s["done"], s["section"])).otherwise(s["done"])
        section = F.when(other, head(r["file"])).otherwise(s["section"])
        fits = F.length(done) + F.length(section) + F.length(r["text"]) < budget
        return F.struct(done.alias("done"), F.when(fits, F.concat(section, r["text"])).otherwise(section).alias("section"),
                        r["file"].alias("file"))

    packed = F.aggregate("rows", zero, step, lambda s: F.when(
        F.length(s["section"]) > 100, F.concat(s["done"], s["section"])).otherwise(s["done"]))
    return rows.select(F.coalesce(packed, F.lit("")).alias("context"))


def secondary_context(secondary: DataFrame, limit=100) -> DataFrame:
    """Supporting symbols as short entries, joined by rules, in score order."""
    entry = F.concat(F.col("type"), F.lit(": "), F.col("name"), F.lit(" @ "), F.substring_index("file", "/", -1), F.lit(":"),
                     F.col("line").cast("string"), F.lit("\n"),
                     F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("  "), F.col("signature"), F.lit("\n"))).otherwise(F.lit("")),
                     F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("  "), F.col("summary"), F.lit("\n"))).otherwise(F.lit("")))
    top = ordering.top(secondary, (F.desc("relevance_score"), "ord"), limit).withColumn("entry", entry)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("relevance_score")).alias("s"), "ord", "entry"))), lambda x: x["entry"]), "\n---\n").alias("context"))


def chunks_for_query(secondary: DataFrame, terms, most=fixed.SECONDARY_CHUNK_CHARS, per_file=8) -> DataFrame:
    """Per-file text of the first eight supporting symbols, split at line boundaries."""
    entry = F.concat(F.lit("### "), F.col("type"), F.lit(": "), F.col("name"), F.lit(" (line "), F.col("line").cast("string"), F.lit(")\n"),
                     F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("Signature: "), F.col("signature"), F.lit("\n"))).otherwise(F.lit("")),
                     F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Summary: "), F.col("summary"), F.lit("\n"))).otherwise(F.lit("")),
                     F.lit("\n"))
    bonus = F.lit(0)
    for t in terms:
        bonus = bonus + F.when(F.contains(F.lower("file"), F.lit(t)), 20).otherwise(0)
    scores = secondary.groupBy("file").agg(F.sum("relevance_score").alias("s")).select("file", (F.col("s") + bonus).alias("file_score"))
    first = ordering.top_per_key(secondary, ["file"], ["ord"], per_file).withColumn("entry", entry)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry"))), lambda x: x["entry"]), "")
    texts = first.groupBy("file").agg(body.alias("body")).select("file", F.concat(
        F.lit("## File: "), F.substring_index("file", "/", -1), F.lit("\nPath: "), F.col("file"), F.lit("\n\n"), F.col("body")).alias("text"))
    pieces = F.when(F.length("text") > most, text.split_at_lines(F.split("text", "\n", -1), most)) \
        .when(F.length("text") > 200, F.array("text")).otherwise(F.array().cast("array<string>"))
    return texts.join(scores, "file").select("file", "file_score", F.posexplode(pieces).alias("part", "chunk"))


def final_context(primary: Column, secondary: Column, query: str, n_symbols: Column, n_blocks: Column) -> Column:
    return F.concat(
        F.lit(f"# Code Analysis Context\n\n**Query:** {query}\n**Search Results:** "), n_symbols.cast("string"), F.lit(" symbols, "),
        n_blocks.cast("string"), F.lit(" code blocks\n\n---\n\n"),
        F.when(text.trim(primary) != "", F.concat(F.lit("# PRIMARY RESULTS (High Relevance)\n"), primary, F.lit("\n\n"))).otherwise(F.lit("")),
        F.when(text.trim(secondary) != "", F.concat(F.lit("# SUPPORTING CONTEXT\n"), secondary)).otherwise(F.lit("")))


def build_context(found: DataFrame, query: str, budget=fixed.CONTEXT_CHARS) -> DataFrame:
    """Two-tier context of search results: file heuristics, tier split, packing, assembly."""
    spark = found.sparkSession
    terms = list(text.evaluate(spark, text.context_terms(F.lit(query))))
    scored = rank.apply_file_scores(found, rank.score_files(found, terms), terms)
    tiers = rank.split_tiers(scored)
    first = primary_context(tiers.filter("tier = 'primary'"), int(budget * fixed.PRIMARY_RATIO))
    second = secondary_context(tiers.filter("tier = 'secondary'"))
    return first.select(final_context(F.col("context"), second.scalar(), query, found.agg(F.count("*")).scalar(), F.lit(0)).alias("context"))


def snippet(before="before", line="match_line", after="after") -> Column:
    return text.trim(F.concat_ws("\n", F.when(F.size(before) > 0, F.array_join(before, "\n")), F.coalesce(line, F.lit("")),
                                 F.when(F.size(after) > 0, F.array_join(after, "\n"))))


def hits_text(hits: DataFrame, per_file=10, order=("ord", "line", "column")) -> DataFrame:
    """Per file the first hits as fenced snippets."""
    first = ordering.top_per_key(hits, ["path"], list(order), per_file)
    ext = F.regexp_extract(F.substring_index("path", "/", -1), r"^.+\.([^.]*)$", 1)
    part = F.concat(F.lit("**Line "), F.col("line").cast("string"), F.lit(":**\n"), fence(F.when(ext == "", "txt").otherwise(ext), snippet()), F.lit("\n"))
    return first.withColumn("part", part).groupBy("path").agg(
        F.concat(F.lit("### "), F.first("path"), F.lit("\n\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "part"))), lambda x: x["part"]), "")).alias("section"), F.min("ord").alias("ord"))


def file_list(hits: DataFrame, most=10) -> DataFrame:
    """First distinct files of a result, in result order."""
    firsts = hits.groupBy("path").agg(F.min("ord").alias("ord"))
    return ordering.top(firsts, ("ord",), most).withColumn("line", F.concat(F.lit("- `"), F.col("path"), F.lit("`")))


def search_text(symbols: DataFrame, query: str, intent: str, target: str, per_file=5, most=30) -> DataFrame:
    """Markdown of a search: header and the leading symbols grouped by file."""
    top = ordering.top(symbols, (F.desc("match_score"), "ord"), most)
    entry = F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("type"), F.lit(") line "), F.col("line").cast("string"),
                     F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" - "), F.col("summary"))).otherwise(F.lit("")), F.lit("\n"))
    ranked = ordering.top_per_key(top.withColumn("entry", entry), ["file"], [F.desc("match_score"), "ord"], per_file)
    sections = ranked.groupBy("file").agg(
        F.concat(F.lit("### "), F.first(F.substring_index("file", "/", -1)), F.lit("\nPath: "), F.first("file"), F.lit("\n\n"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry"))), lambda x: x["entry"]), ""), F.lit("\n")).alias("s"),
        F.min(F.struct((-F.col("match_score")).alias("m"), "ord")).alias("o"))
    head = f'# Search Results for: "{query}"\nIntent: {intent}, Target: "{target}"\n\n'
    n = symbols.agg(F.count("*")).scalar().cast("string")
    return sections.agg(F.concat(F.lit(head), F.lit("## Relevant Symbols ("), n, F.lit(" found)\n\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "")).alias("context"))


def numbered_lines(content: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(F.split(content, "\n", -1), 1, most),
                                    lambda t, i: F.concat((i + 1).cast("string"), F.lit(": "), t)), "\n")


def workspace_context(files: DataFrame, terms, max_files=15, per_file=400, total=3000) -> DataFrame:
    """Best files under a total line budget: a file enters while the lines before it are under it."""
    scored = files.withColumn("score", rank.workspace_file_score(F.concat(F.lit("/"), F.col("path")), terms)) \
        .withColumn("lines_used", F.least(text.line_count(F.col("content")), F.lit(per_file)))
    best = ordering.top(scored, (F.desc("score"), "ord"), max_files)
    w = Window.orderBy(F.desc("score"), "ord")  # max_files rows
    used = F.coalesce(F.sum("lines_used").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("lines_before", used).filter(F.col("lines_before") < total) \
        .select("path", "score", "lines_used", "lines_before", numbered_lines(F.col("content"), per_file).alias("text"))


def combined_content(piped: Column, history: Column, workspace: Column, attachments: Column) -> Column:
    def part(c, title=""):
        return F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(title), c, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(part(piped), part(history), part(workspace, "## Reference Code from Workspace\n\n"),
                    part(attachments, "## Reference from Attachments\n\n"))


#: Sources of a request in the order in which their text is put together, with the label that says a source was used.
SOURCES = (("piped", "🔗 Piped"), ("history", "📜 History"), ("workspace", "🔍 Workspace"), ("attachments", "📎 Attachments"))


def gather_sources(parts: DataFrame, requests: DataFrame, least=50) -> DataFrame:
    """(request, sources_used, content) of every request.

    ``parts``: (request, source, ord, name, content), any number of parts of a source; ``requests``: (request, h, w, a, llm), the sources it asks for.
    Piped text is always used and takes the place of history; workspace text needs no length, the others more than ``least`` characters.  A request
    without any source still gets a row.
    """
    joined = parts.groupBy("request", "source").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda p: F.coalesce(
        p["content"], F.lit(""))), "").alias("content"))
    rows = requests.join(joined.groupBy("request").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("n", "content")))).alias("s")), "request", "left")
    part = lambda k: F.coalesce(F.try_element_at("s", F.lit(k))["content"], F.lit(""))
    number = lambda k: F.coalesce(F.try_element_at("s", F.lit(k))["n"], F.lit(0)).cast("string")
    piped, long = part("piped"), lambda c: F.length(c) > least
    history = F.when(F.col("h") & (piped == ""), part("history")).otherwise("")
    workspace = F.when(F.col("w"), part("workspace")).otherwise("")
    attached = F.when(F.col("a") & long(part("attachments")), part("attachments")).otherwise("")
    labels = dict(SOURCES)
    used = F.array_compact(F.array(
        F.when(long(piped), labels["piped"]), F.when(long(history), labels["history"]),
        F.when(workspace != "", F.concat(F.lit(labels["workspace"] + " ("), number("workspace"), F.lit(" files)"))),
        F.when(attached != "", F.concat(F.lit(labels["attachments"] + " ("), number("attachments"), F.lit(")"))), F.when(F.col("llm"), "🤖 LLM only")))
    return rows.select("request", used.alias("sources_used"), combined_content(piped, history, workspace, attached).alias("content"))
