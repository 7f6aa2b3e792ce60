"""Corpus statistics."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, paths, text
from . import ordering


def with_file_facts(files: DataFrame) -> DataFrame:
    """Adds ext, top_dir, n_lines and size; size is the character length unless given."""
    ext = F.lower(paths.extension(F.col("path")))
    df = files if "size" in files.columns else files.withColumn("size", F.length("content").cast("bigint"))
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("(root)"))
    return df.withColumn("ext", F.when(ext == "", "(no ext)").otherwise(ext)).withColumn("top_dir", top) \
        .withColumn("n_lines", text.line_count(F.col("content")).cast("bigint"))


def workspace_stats(files: DataFrame, count_lines_for=None) -> DataFrame:
    """By extension, by top directory and in total, from one scan (grouping sets); lines of ``count_lines_for`` extensions only, if given."""
    facts = with_file_facts(files)
    if count_lines_for is not None:
        facts = facts.withColumn("n_lines", F.when(F.col("ext").isin(*count_lines_for), F.col("n_lines")).otherwise(0))
    return facts.groupingSets([[F.col("ext")], [F.col("top_dir")], []], F.col("ext"), F.col("top_dir")).agg(
        F.count("*").alias("files"), F.sum("n_lines").alias("lines"), F.sum("size").alias("size"),
        F.grouping_id().alias("gid")) \
        .select(F.when(F.col("gid") == 1, "extension").when(F.col("gid") == 2, "directory").otherwise("total").alias("level"),
                F.coalesce("ext", "top_dir", F.lit("")).alias("name"), "files", "lines", "size")


def largest_files(files: DataFrame, n=10) -> DataFrame:
    facts = with_file_facts(files).select("path", "n_lines", "size", "ord")
    return ordering.top(facts, (F.desc("n_lines"), "ord"), n).drop("ord")


def language_stats(files: DataFrame, n=None, by_extension=True) -> DataFrame:
    facts = with_file_facts(files)
    lang = F.try_element_at(paths.lit_map(fixed.DISPLAY_LANGUAGES), F.col("ext")) if by_extension else F.col("language")
    stats = facts.withColumn("lang", lang).filter(F.col("lang").isNotNull()) \
        .groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines"), F.sum("size").alias("size"))
    return stats if n is None else ordering.top(stats, (F.desc("lines"), "lang"), n)


def attachment_stats(files: DataFrame) -> DataFrame:
    return with_file_facts(files).agg(F.count("*").alias("count"), F.sum("size").alias("total_size"),
                                      F.sum("n_lines").alias("total_lines"))


def symbol_stats(symbols: DataFrame, lists: DataFrame = None) -> DataFrame:
    """Symbol counts: all, callables, classes, variables, and call edges if given."""
    kind = F.col("type")
    out = symbols.agg(
        F.count("*").alias("symbols"), F.count_distinct("file").alias("files"),
        F.count_if(kind.isin("function", "procedure", "method", "subproc")).alias("functions"),
        F.count_if(kind.isin("class", "struct", "interface")).alias("classes"),
        F.count_if(kind.isin(*fixed.VARIABLE_TYPES)).alias("variables"),
        F.count("summary" if "summary" in symbols.columns else F.lit(None)).alias("summaries"))
    if lists is None:
        return out
    return out.select("*", lists.agg(F.coalesce(F.sum(F.size("calls")), F.lit(0))).scalar().alias("edges"))


def type_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("type").agg(F.count("*").alias("n"))


def hits_per_file(hits: DataFrame, extensions=fixed.SCOPE_CODE_EXTENSIONS) -> DataFrame:
    df = hits if extensions is None else hits.filter(paths.bare_extension(F.col("path")).isin(*extensions))
    return df.groupBy("path").agg(F.count("*").alias("hits"))


def repo_structure(files: DataFrame, depth=4) -> DataFrame:
    """Totals of directories, configuration files and source files down to a depth."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ok = ~F.exists(dirs, lambda d: d.isin(*fixed.STRUCTURE_IGNORED_DIRS) | F.startswith(d, F.lit("."))) & (F.size(parts) <= depth + 1)
    kept = files.filter(ok)
    ext = F.lower(paths.extension(F.col("path")))
    totals = kept.agg(F.count("*").alias("total_files"),
                      F.count_if(paths.file_name(F.col("path")).isin(*fixed.CONFIG_FILE_NAMES)).alias("config_files"),
                      F.count_if(ext.isin(*fixed.STRUCTURE_SOURCE_EXTENSIONS)).alias("source_files"))
    n_dirs = kept.select(F.explode(paths.ancestors(F.col("path"))).alias("d")).distinct().agg(F.count("*"))
    return totals.select(n_dirs.scalar().alias("directories"), "*")
