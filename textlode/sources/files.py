"""Files to a corpus: (path, content, language, line_count, is_source, size, ord)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, paths, text
from ..operators import ordering


def decode(raw: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8.  Latin-1 has a character for every byte, so an encoding behind it would never be tried."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def with_order(df: DataFrame) -> DataFrame:
    """Order key of a corpus: the path itself, so no global numbering pass is needed."""
    return df.withColumn("ord", F.col("path"))


def corpus(df: DataFrame) -> DataFrame:
    """Adds language, line count and the source flag to (path, content)."""
    out = df if "language" in df.columns else df.withColumn("language", paths.language(F.col("path")))
    return out.withColumn("line_count", text.line_count(F.col("content"))).withColumn("is_source", paths.is_source(F.col("language")))


def scan(spark, root: str, max_depth=None, skip_dirs=fixed.SKIP_DIRS, glob=None, keep=None, binary=False, max_bytes=None) -> DataFrame:
    """Recursive scan of a folder.

    Size (``max_bytes``), name, depth and directory rules are applied on file metadata, before any
    content is read.  ``keep`` adds a condition on the relative path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", r"^(file:/*|[a-z0-9]+://[^/]*/)", "/")
    df = reader.load(base).withColumn("path", paths.relative_to(rel, F.lit(base)))
    return select_files(df.withColumnRenamed("content", "raw").withColumnRenamed("modificationTime", "modified"), max_depth, skip_dirs, keep, binary, max_bytes)


def select_files(df: DataFrame, max_depth=None, skip_dirs=fixed.SKIP_DIRS, keep=None, binary=False, max_bytes=None) -> DataFrame:
    """The rules of a scan on any table of (path, length, raw, ...): folders, depth, size and kind of file."""
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    df = df.filter(~F.exists(dirs, lambda d: d.isin(*skip_dirs) | F.startswith(d, F.lit("."))))
    if max_depth is not None:
        df = df.filter(F.size(parts) - 1 <= max_depth)
    if not binary:
        df = df.filter(~paths.is_binary(F.col("path")))
    if keep is not None:
        df = df.filter(keep(F.col("path")))
    return with_order(df.withColumnRenamed("length", "size"))


def read_text(spark, root: str, **options) -> DataFrame:
    """Corpus of a folder's text files."""
    raw = scan(spark, root, **options)
    return corpus(raw.withColumn("content", decode(F.col("raw"))).drop("raw"))


def indexable(files: DataFrame) -> DataFrame:
    return files.filter(paths.should_index(F.col("path")))


def limited(files: DataFrame, most: int) -> DataFrame:
    """The first files by path, for a caller who wants so many."""
    return ordering.top(files, ("path",), most)


def document_corpus(docs: DataFrame, key="doc_id", body="text", lang="lang", source="source") -> DataFrame:
    """A table of texts as a corpus: path = source/lang/id.txt."""
    return docs.select(
        F.concat_ws("/", source, lang, F.concat(F.col(key).cast("string"), F.lit(".txt"))).alias("path"),
        F.col(body).alias("content"), F.col(lang).alias("language"), F.col(key).alias("ord"))


# --- walking searches ---------------------------------------------------------

def search_files(files: DataFrame, terms, limit: int, max_depth=8, include=(), exclude=()) -> DataFrame:
    """Files hit by name or path on any term, otherwise by content on any term."""
    parts = F.split("path", "/")
    ext = F.lower(paths.extension(F.col("path")))
    df = files.filter((F.size(parts) <= max_depth + 1) & ext.isin(*fixed.WALK_CODE_EXTENSIONS))
    if include or exclude:
        df = df.filter((F.size(parts) > 1) & paths.folder_allowed(F.get(parts, F.lit(0)), include, exclude))
    low, body = F.lower("path"), F.lower("content")
    hit = F.lit(None).cast("string")
    for t in reversed(list(terms)):
        hit = F.when(F.contains(body, F.lit(t)), F.lit(t)).otherwise(hit)
    by_name = F.lit(None).cast("string")
    for t in reversed(list(terms)):
        by_name = F.when(F.contains(low, F.lit(t)), F.lit(t)).otherwise(by_name)
    df = df.withColumn("matched_term", F.coalesce(by_name, hit)).filter("matched_term is not null")
    return ordering.top(df, ("ord",), limit)


def pattern_files(files: DataFrame, limit=20, max_depth=6) -> DataFrame:
    """Files with a layer suffix such as Service.java; service-like folders do not count as depth."""
    name = paths.file_name(F.col("path"))
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    depth = F.size(F.filter(dirs, lambda d: ~F.lower(d).isin(*fixed.TRANSPARENT_DIRS)))
    suffix = F.lit(None).cast("string")
    for s in reversed(fixed.PATTERN_SUFFIXES):
        suffix = F.when(F.endswith(name, F.lit(s)), F.lit(s)).otherwise(suffix)
    df = files.filter(depth <= max_depth).withColumn("suffix", suffix).filter("suffix is not null")
    return ordering.top(df, ("ord",), limit).withColumn("matched_term", F.replace("suffix", F.lit(".java"), F.lit("")))


def tree(files: DataFrame, depth=2, per_dir=20, limit=50) -> DataFrame:
    """Directory listing in walk order: directories first, 20 entries per directory, 50 lines."""
    parts = F.split("path", "/")
    n = F.size(parts)
    entries = files.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(depth + 1))),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.get(parts, i - 1).alias("name"),
                           (i < n).alias("is_dir"), (i - 1).alias("level")))).alias("e")).select("e.*").distinct()
    hidden = F.startswith("name", F.lit(".")) | F.col("name").isin(*fixed.SKIP_DIRS) \
        | F.exists(F.split("parent", "/"), lambda d: d.isin(*fixed.SKIP_DIRS) | F.startswith(d, F.lit(".")))
    kept = ordering.top_per_key(entries.filter(~hidden), ["parent"], [F.desc("is_dir"), "name"], per_dir, "place")
    # a directory cut from its parent's listing takes its subtree with it
    for level in range(1, depth + 1):
        dirs = kept.filter((F.col("level") == level - 1) & F.col("is_dir")) \
            .select(F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name")).alias("parent"))
        kept = kept.filter(F.col("level") != level).unionByName(kept.filter(F.col("level") == level).join(dirs, "parent", "left_semi"))
    walk = F.transform(F.concat(F.filter(F.split("parent", "/"), lambda p: p != ""), F.array("name")),
                       lambda p, i: F.concat(F.when(F.col("is_dir") | (i < F.col("level")), F.lit("0")).otherwise(F.lit("1")), p))
    return ordering.top(kept.withColumn("walk", F.array_join(walk, "\x01")), ("walk",), limit) \
        .select("level", "parent", "name", "is_dir", "walk")


def sample_sources(files: DataFrame, n_files=10, n_lines=100) -> DataFrame:
    ext = F.lower(paths.extension(F.col("path")))
    src = files.filter(ext.isin(*fixed.STRUCTURE_SOURCE_EXTENSIONS))
    return first_lines_of(src, n_files, n_lines)


def first_lines_of(files: DataFrame, n_files: int, n_lines: int) -> DataFrame:
    return ordering.top(files, ("ord",), n_files).select("path", text.first_lines(F.col("content"), n_lines).alias("head"))


def config_files(files: DataFrame, n=5, most=3000) -> DataFrame:
    conf = files.filter(paths.file_name(F.col("path")).isin(*fixed.CONFIG_FILE_NAMES))
    return ordering.top(conf, ("ord",), n).select("path", capped(F.col("content"), most).alias("content"))


def capped(content: Column, most: int) -> Column:
    return F.when(F.length(content) > most, F.concat(F.left(content, F.lit(most)), F.lit("\n... [truncated]"))).otherwise(content)


def attachments(files: DataFrame, most=50_000) -> DataFrame:
    """Attached files as fenced report sections, 50 000 characters each."""
    name = paths.file_name(F.col("path"))
    return files.select("path", name.alias("name"), F.concat(
        F.lit("\n### File: "), name, F.lit("\n```\n"), F.left("content", F.lit(most)), F.lit("\n```\n")).alias("section"))
