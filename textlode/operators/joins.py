"""Joins that files, lines and symbols need: range, nearest, suffix, sibling."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, paths
from . import ordering


def symbols_near(hits: DataFrame, symbols: DataFrame, reach=50) -> DataFrame:
    """Range join on line distance inside a file, on buckets of ``reach`` lines.

    A hit looks only at its own and the two neighbouring buckets, so a file with many
    hits and symbols spreads over its buckets instead of meeting in one task.  Symbols are
    merged past a bucket's hits, and neither side is held whole.
    """
    size = reach + 1
    h = hits.select("*", F.explode(F.array(*[F.floor(F.col("line") / size) + d for d in (-1, 0, 1)])).alias("__b"))
    s = symbols.select(F.col("file").alias("path"), F.struct(*symbols.columns).alias("symbol"),
                       F.floor(F.col("line") / size).alias("__b"))
    near = s.join(ordering.apart(h), ["path", "__b"]).filter(F.abs(F.col("symbol.line") - F.col("line")) <= reach)
    return near.select(*hits.columns, "symbol")


def nearest_symbol(hits: DataFrame, symbols: DataFrame, reach=50) -> DataFrame:
    """Closest symbol under ``reach`` lines for each hit; the earliest symbol wins a tie."""
    near = symbols_near(hits, symbols, reach - 1)
    keys = [c for c in hits.columns]
    return near.groupBy(*keys).agg(F.min_by("symbol", F.struct(
        F.abs(F.col("symbol.line") - F.col("line")), F.col("symbol.ord"))).alias("symbol"))


def in_scope(results: DataFrame, scope: DataFrame, column="file") -> DataFrame:
    return results.join(scope.select(F.col("path").alias(column)), column, "left_semi")


def in_scope_by_suffix(files: DataFrame, scope: DataFrame, most=5) -> DataFrame:
    """Files sharing any of their last 1..5 path segments with a scope path."""
    keys = scope.select(F.explode(paths.suffixes(F.col("path"), most)).alias("suffix")).distinct()
    mine = files.select("path", F.explode(paths.suffixes(F.col("path"), most)).alias("suffix"))
    kept = mine.join(keys, "suffix", "left_semi").select("path").distinct()
    return files.join(kept, "path", "left_semi")


def directory_matches(dirs: DataFrame, terms) -> DataFrame:
    """Directory entries whose base name contains a term or is contained in one."""
    base = F.lower(F.substring_index("dir", "/", -1))
    cond = F.lit(False)
    which = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(terms))):
        c = F.contains(base, F.lit(t.lower())) | F.contains(F.lit(t.lower()), base)
        cond, which = cond | c, F.when(c, F.lit(i)).otherwise(which)
    return dirs.filter(cond).withColumn("term_no", which)


def paths_with_any(files: DataFrame, keywords) -> DataFrame:
    """Files whose path contains a keyword; the first keyword to match is kept."""
    low, which = F.lower("path"), F.lit(None).cast("string")
    for k in reversed(list(keywords)):
        which = F.when(F.contains(low, F.lit(k.lower())), F.lit(k)).otherwise(which)
    return files.withColumn("matched", which).filter("matched is not null")


def siblings(files: DataFrame, found: DataFrame, terms) -> DataFrame:
    """Code files beside a directory named after a term, under the same grandparent.

    Files in the matched directory itself and files already found stay out.
    """
    parts = F.split("path", "/")
    parent, grand = F.lower(F.element_at(parts, -2)), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "/")
    deep = files.filter(F.size(parts) >= 3).select("path", "ord", F.element_at(parts, -2).alias("parent"),
                                                   parent.alias("low"), grand.alias("grand"))
    cond = F.lit(False)
    for t in terms:
        cond = cond | F.startswith("low", F.lit(t)) | F.endswith("low", F.lit(t))
    matched = deep.filter(cond).select("grand", "parent").distinct()
    code = deep.filter(paths.bare_extension(F.col("path")).isin(*fixed.SIBLING_EXTENSIONS))
    return code.join(matched.select("grand").distinct(), "grand", "left_semi") \
        .join(matched, ["grand", "parent"], "left_anti") \
        .join(found.select("path"), "path", "left_anti") \
        .select("path", "ord", F.lit(40).alias("score"), F.col("parent").alias("sibling_dir"))


def named_files(files: DataFrame, names, lines=100, after=20) -> DataFrame:
    """First file per asked name (path contains it), with its first lines and the lines behind them."""
    out = None
    for n, name in enumerate(names):
        want = name.lstrip("/").strip().lower()
        hit = ordering.top(files.filter(F.contains(F.lower("path"), F.lit(want))), ("ord",), 1)
        parts = F.split("content", "\n", -1)
        row = hit.select(F.lit(n).alias("name_no"), F.lit(name).alias("asked"), "path",
                         F.array_join(F.slice(parts, 1, lines), "\n").alias("head"),
                         F.slice(parts, lines + 1, after).alias("after"))
        out = row if out is None else out.unionByName(row)
    return out
