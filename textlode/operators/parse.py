"""Source text to symbol rows, bodies and calls, as DataFrame operators.

Patterns run over whole files inside the JVM; positions come from running lengths
(``functions.matching``).  Body ends are found by sweeping lines and definitions
together, so a file with many functions costs a sort, not a rescan per function.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, grammar, text
from ..functions.matching import Rule, ascii_edges, match_rows_by
from . import ordering

SYMBOL_FIELDS = ("name", "type", "line", "signature", "params", "return_type", "data_type", "scope", "level", "summary")


def _rules():
    """Rule sets with all patterns numbered once; a language's rules keep their own order."""
    sets, kinds = [], []
    tables = {}
    for lang, rules in grammar.SYMBOL_RULES.items():
        tables.setdefault(id(rules), ([], rules))[0].append(lang)
    for langs, rules in list(tables.values()) + [([], grammar.GENERIC)]:
        sets.append((len(kinds), langs, [Rule(p, g) for _, p, g in rules]))
        kinds += [k for k, _, _ in rules]
    return sets, kinds


def raw_matches(files: DataFrame) -> DataFrame:
    """Every pattern match of every file's own language, with position; one scan of the corpus."""
    sets, kinds = _rules()
    needs_depth = [n for n, k in enumerate(kinds) if k == "global"]
    rows = match_rows_by(files, ["path", "language", "ord"], "content", "language", sets, needs_depth)
    labels = F.array(*[F.lit(k) for k in kinds])
    return rows.withColumn("kind", F.get(labels, F.col("rule")))


def parse_symbols(files: DataFrame, with_summary=True) -> DataFrame:
    """Symbol rows in definition order; ``ord`` is (file order, rule, match number)."""
    m = raw_matches(files)
    kind, name = F.col("kind"), F.col("g1")
    second, third = text.trim(F.col("g2")), text.trim(F.col("g3"))
    c_like = F.col("language").isin("c", "cpp", "h")
    java_like = F.col("language").isin("java", "kotlin", "scala")
    generic = ~F.col("language").isin(*grammar.SYMBOL_RULES)

    keep = ~((kind == "global") & (F.col("depth") != 0)) \
        & ~((kind == "paragraph") & name.rlike(grammar.COBOL_NON_PARAGRAPHS)) \
        & ~((kind == "upper_constant") & (F.startswith(name, F.lit("_")) | (name != F.upper(name)))) \
        & ~((kind == "package") & (F.col("match_no") > 0))
    for k, words in grammar.METHOD_KEYWORDS.items():
        keep = keep & ~((kind == k) & name.isin(*words))

    level = F.when(kind == "level_item", F.col("g2").cast("int"))
    type_ = (F.when(kind == "global", "variable").when(kind == "typed_variable", "variable")
             .when(kind.isin("typed_method", "plain_method"), "method")
             .when(kind == "indented", F.when(F.length("g2") > 0, "method").otherwise("function"))
             .when(kind == "upper_constant", "constant")
             .when((kind == "macro") & (F.length("g2") > 0), "macro-function")
             .when(kind == "level_item", F.when(level.isin(1, 77), "record").otherwise("field"))
             .otherwise(kind))
    has_params = (kind.isin("typed_method", "plain_method", "indented")) | ((kind == "function") & c_like)
    returns = F.when((kind == "function") & c_like, second).when(kind.isin("typed_method", "plain_method"), F.col("g2"))
    named = (F.when(kind == "program", F.regexp_replace(name, r"^([^.]*)\.", "$1"))
             .when((kind == "impl") & (F.length("g2") > 0), F.concat(F.col("g2"), F.lit(" for "), name))
             .otherwise(name))
    out = m.filter(keep).select(
        F.col("path").alias("file"), "language", named.alias("name"), type_.alias("type"),
        F.when(kind == "package", F.lit(1)).otherwise(F.col("line")).alias("line"),
        F.when(has_params & (c_like | java_like) & kind.isin("function", "typed_method"),
               F.concat(returns, F.lit(" "), name, F.lit("("), third, F.lit(")"))).alias("signature"),
        F.when(has_params, third).when(kind == "macro", F.coalesce("g2", F.lit(""))).alias("params"),
        returns.alias("return_type"),
        F.when(kind == "global", second).when(kind.isin("field", "property"), F.nullif("g2", F.lit("")))
        .when(kind == "typed_variable", F.upper("g2")).alias("data_type"),
        F.when(kind == "global", F.lit("global")).alias("scope"), level.alias("level"),
        generic.alias("__generic"), F.struct(F.col("ord").alias("file_ord"), "rule", "match_no").alias("ord"))
    # the generic rules overlap: first rule wins per (name, line)
    own = out.filter(~F.col("__generic"))
    loose = out.filter("__generic")
    loose = ordering.first_by(loose, ["file", "name", "line"], ["ord"]).select(out.columns)
    out = own.unionByName(loose).drop("__generic")
    return add_summaries(out, files) if with_summary else out


def _comment_summary(above: Column) -> Column:
    """Fold over the lines above a definition, nearest first."""
    start = F.struct(F.lit(None).cast("string").alias("summary"), F.lit(False).alias("stop"))

    def step(s, raw):
        line = text.trim(raw)
        comment = line.rlike(r"^(//|#|\*|--)")
        said = text.trim(F.regexp_replace(line, r"^[/*#-]+\s*", ""))
        breaks = (F.length(line) > 0) & ~F.startswith(line, F.lit("/*")) & ~F.startswith(line, F.lit('"""'))
        return F.when(s["stop"], s).otherwise(F.struct(
            F.when(comment, said).otherwise(s["summary"]).alias("summary"),
            F.when(comment, F.length(said) > 10).otherwise(breaks).alias("stop")))

    return F.aggregate(F.reverse(above), start, step, lambda s: s["summary"])


def add_summaries(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Summary of callables: the comment up to four lines above, else words of the name."""
    lines = files.select(F.col("path").alias("file"), F.split("content", "\n", -1).alias("lines"))
    first = F.greatest(F.col("line") - 4, F.lit(1))
    above = F.slice("lines", first, F.col("line") - first)
    said = F.nullif(_comment_summary(above), F.lit(""))
    callable_ = F.col("type").isin(*fixed.SUMMARY_TYPES)
    return symbols.join(ordering.apart(lines), "file").withColumn(
        "summary", F.when(callable_, F.coalesce(said, text.summary_from_name(F.col("name"))))).drop("lines")


def symbol_table(symbols: DataFrame) -> DataFrame:
    """One row per name@file: the last definition's fields at the first definition's place."""
    rest = [c for c in symbols.columns if c not in ("file", "name", "ord")]
    return symbols.groupBy("file", "name").agg(
        F.max_by(F.struct(*rest), F.col("ord")).alias("__last"), F.min("ord").alias("ord")) \
        .select(F.concat_ws("@", "name", "file").alias("key"), "file", "name", "__last.*", "ord")


def variables(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("type").isin(*fixed.VARIABLE_TYPES)).select(
        "key", "name", F.coalesce("data_type", "type").alias("data_type"), "file", "line",
        F.coalesce("scope", F.lit("global")).alias("scope"), "ord")


def first_definitions(symbols: DataFrame) -> DataFrame:
    """Bare-name lookup: the first definition of each name over all files."""
    return ordering.first_by(symbols, ["name"], ["ord"])


# --- bodies -------------------------------------------------------------------

def _marks(style: Column, t: Column) -> Column:
    """What a line opens (1) and closes (-1), in order: its braces, or one BEGIN and one END."""
    braces = F.transform(F.regexp_extract_all(t, F.lit("([{}])"), F.lit(1)), lambda x: F.when(x == "{", 1).otherwise(-1))
    up = F.upper(t)
    words = F.filter(F.array(F.when(F.contains(up, F.lit("BEGIN")), 1), F.when(F.contains(up, F.lit("END")), -1)), lambda x: x.isNotNull())
    return F.when(style == "brace", braces).otherwise(words)


def _lowered(marks: Column) -> Column:
    """Depths, relative to a line's start, that its closings come down to, and its net change: (levels, d)."""
    start = F.struct(F.array().cast("array<int>").alias("levels"), F.lit(0).alias("d"))
    return F.aggregate(marks, start, lambda s, m: F.struct(
        F.when(m < 0, F.concat(s["levels"], F.array(s["d"] + m))).otherwise(s["levels"]).alias("levels"), (s["d"] + m).alias("d")))


def _closings(style: Column, lines: Column, groups: Column, kind: str) -> Column:
    """The definitions of a file, each with where it ends, as (d, end_line), null if it stays open: one pass over the lines, open definitions on a stack.

    ``groups``: (line, defs) in order of lines; ``kind``: type of a definition.  A definition inside braces or BEGIN/END words ends behind the first
    line whose closings come down to the depth it started at; an indented one at the next line that is no deeper; a COBOL one at the next label, or
    behind the next END- line.
    """
    opened_type, closed_type = f"array<struct<level:int,d:{kind}>>", f"array<struct<d:{kind},end_line:int>>"
    nothing = F.array().cast(opened_type)

    def step(s, e, level, closes, end, own_too):
        group = F.get(groups, s["next"])  # definitions that start here: the next in turn
        hit = F.coalesce(group["line"] <= e["line"], F.lit(False))
        own = F.when(hit, F.transform(group["defs"], lambda d: F.struct(level.cast("int").alias("level"), d.alias("d")))).otherwise(nothing)
        before = F.concat(s["open"], own) if own_too else s["open"]
        ended = F.transform(F.filter(before, lambda o: closes(o["level"])), lambda o: F.struct(o["d"].alias("d"), end.cast("int").alias("end_line")))
        still = F.filter(before, lambda o: ~closes(o["level"]))
        depth = s["depth"] + e["m"]["d"] if own_too else s["depth"]
        return F.struct(depth.alias("depth"), (s["next"] + hit.cast("int")).alias("next"),
                        (still if own_too else F.concat(still, own)).alias("open"), F.concat(s["out"], ended).alias("out"))

    def fold(event, step_of):
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("next"), nothing.alias("open"), F.array().cast(closed_type).alias("out"))
        unclosed = lambda d: F.struct(d.alias("d"), F.lit(None).cast("int").alias("end_line"))
        return F.aggregate(F.transform(lines, event), start, step_of, lambda s: F.concat(
            s["out"], F.transform(s["open"], lambda o: unclosed(o["d"])),
            F.transform(F.flatten(F.transform(F.slice(groups, s["next"] + 1, F.size(groups)), lambda g: g["defs"])), unclosed)))

    def line(i):
        return (i + 1).cast("int").alias("line")

    def braces(t, i):
        return F.struct(line(i), _lowered(_marks(style, t)).alias("m"))

    def indent(t, i):
        return F.struct(line(i), F.length(F.regexp_extract(t, rf"^({text.SPACE}*)", 1)).alias("indent"), (F.length(text.trim(t)) > 0).alias("solid"))

    def label(t, i):
        stop = (F.when(t.rlike(r"(?i)^.{7}[A-Z0-9][-A-Z0-9]*\s*(SECTION)?\s*\.\s*$"), 0)
                .when(F.substr(t, F.lit(8)).rlike(r"(?i)^\s*END-"), 1))
        return F.struct(line(i), stop.alias("stop"))

    nested = fold(braces, lambda s, e: step(s, e, s["depth"], lambda v: F.array_contains(e["m"]["levels"], v - s["depth"]), e["line"] + 1, True))
    indented = fold(indent, lambda s, e: step(s, e, e["indent"], lambda v: e["solid"] & (v >= e["indent"]), e["line"], False))
    labelled = fold(label, lambda s, e: step(s, e, F.lit(0), lambda v: e["stop"].isNotNull(), e["line"] + e["stop"], False))
    return F.when(style == "indent", indented).when(style == "label", labelled).otherwise(nested)


def bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, lines, d, end_line) of every callable, d a struct of line, ord, key, name and language; lines 1-based and inclusive.

    Braces, BEGIN/END words, indentation or COBOL labels, by language.  Bodies that never close run 200 lines (braces and words) or to the end of the
    file.  A file is one row: its definitions meet its text once, and an array fold walks its lines.
    """
    style = F.coalesce(F.try_element_at(_style_map(), F.col("language")), F.lit("brace"))
    own = F.struct("line", "ord", "key", "name", "language")
    # a file's own definitions, so bounded by its text; split and style stand below the join, where they are computed once
    defs = symbols.filter(F.col("type").isin(*fixed.CALLABLE_TYPES)).select(F.col("file").alias("path"), F.col("line").cast("int").alias("line"), own.alias("d"))
    groups = (defs.repartition("path").groupBy("path", "line").agg(F.collect_list("d").alias("defs"))
              .groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "defs"))).alias("groups")))
    rows = files.select("path", style.alias("style"), F.split("content", "\n", -1).alias("lines"), text.line_count(F.col("content")).alias("n_lines")).join(ordering.apart(groups), "path")
    kind = groups.schema["groups"].dataType.elementType["defs"].dataType.elementType.simpleString()
    closed = _closings(F.col("style"), F.col("lines"), F.col("groups"), kind)
    out = rows.select("path", "style", "lines", "n_lines", F.explode(closed).alias("e")).select("path", "style", "lines", "n_lines", "e.*")
    open_end = F.when(F.col("style").isin("brace", "keyword"), F.col("d.line") + 200).otherwise(F.col("n_lines"))
    return out.select("path", "lines", "d", F.least(F.coalesce("end_line", open_end), F.col("n_lines")).alias("end_line"))


def body_ends(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Last body line (1-based, inclusive) of every callable: (key, path, name, language, line, ord, end_line)."""
    return bodies(symbols, files).select("d.key", "path", "d.name", "d.language", "d.line", "d.ord", "end_line")


def _style_map():
    return F.create_map(*[F.lit(x) for pair in {
        **grammar.BODY_STYLE, **{a: grammar.BODY_STYLE[t] for a, t in grammar.CALL_ALIASES.items()
                                 if t in grammar.BODY_STYLE}}.items() for x in pair])


# --- calls --------------------------------------------------------------------

def extract_calls(code: Column, language: Column) -> Column:
    """Distinct callee names in a piece of code, comments and strings removed first."""
    def calls(patterns, words, comments, strings):
        clean = code
        for p in comments:
            clean = F.regexp_replace(clean, p, " ")
        for p in strings:
            clean = F.regexp_replace(clean, p, '""')
        found = F.concat(*[F.regexp_extract_all(clean, F.lit(ascii_edges(p)), F.lit(1)) for p in patterns])
        skip = [w.lower() for w in words]
        return F.filter(F.array_distinct(found), lambda w: (w != "") & ~F.lower(w).isin(*skip))

    aliases = {}
    for alias, target in grammar.CALL_ALIASES.items():
        aliases.setdefault(target, [target]).append(alias)
    expr = None
    for lang, rule in grammar.CALL_RULES.items():
        cond = language.isin(*aliases.get(lang, [lang]))
        expr = F.when(cond, calls(*rule)) if expr is None else expr.when(cond, calls(*rule))
    return expr.otherwise(calls(*grammar.CALL_RULES["c"]))


def call_lists(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Per callable definition its distinct callees without itself: (caller, file, ord, calls)."""
    code = F.array_join(F.slice("lines", F.col("d.line"), F.greatest(F.col("end_line") - F.col("d.line") + 1, F.lit(0))), "\n")
    calls = F.filter(extract_calls(code, F.col("d.language")), lambda c: c != F.col("d.name"))
    return bodies(symbols, files).select(F.col("d.name").alias("caller"), F.col("path").alias("file"), "d.ord", calls.alias("calls")) \
        .filter(F.size("calls") > 0)


def call_edges(lists: DataFrame, mode="union") -> DataFrame:
    """Distinct caller -> callee edges; mode "reference" keeps only the last definition of each caller."""
    if mode == "reference":
        lists = lists.groupBy("caller").agg(F.max_by("calls", "ord").alias("calls"), F.max("ord").alias("ord"))
    return lists.select("caller", F.explode("calls").alias("callee"), "ord") \
        .groupBy("caller", "callee").agg(F.min("ord").alias("ord"))


# --- single-line extraction ---------------------------------------------------------

def line_functions(files: DataFrame) -> DataFrame:
    """Functions found by one-line patterns, by file extension: (path, name, line)."""
    ext = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    lines = files.select("path", "ord", ext.alias("ext"), "content").select("path", "ord", "ext", F.posexplode(F.split("content", "\n", -1)).alias("i", "t"))
    name = F.lit(None).cast("string")
    for exts, patterns in grammar.LINE_DEFINITIONS:
        found = F.coalesce(*[F.nullif(F.regexp_extract("t", p, g), F.lit("")) for p, g in patterns])
        name = F.when(F.col("ext").isin(*exts), found).otherwise(name)
    return lines.select("path", "ord", name.alias("name"), (F.col("i") + 1).alias("line")).filter("name is not null")
