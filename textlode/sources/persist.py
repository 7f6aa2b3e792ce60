"""Index tables on disk: one Parquet table per structure, guarded by a fingerprint."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..operators import index, ordering

VERSION = "2.0"


def save_tables(tables: dict, root: str, partition_by=None):
    """Write named tables; postings and symbols may be partitioned by a low-cardinality column."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        cols = (partition_by or {}).get(name)
        (w.partitionBy(*cols) if cols else w).parquet(f"{root}/{name}")


def load_tables(spark, root: str, names) -> dict:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def derived(files: DataFrame, symbols: DataFrame) -> dict:
    """Tables that are re-derived on import rather than stored."""
    from ..operators.grep import corpus_lines
    return {"symbol_trigrams": index.symbol_trigrams(symbols), "file_trigrams": index.file_name_trigrams(files),
            "code_trigrams": index.line_trigrams(corpus_lines(files.filter("is_source") if "is_source" in files.columns else files)),
            "symbol_names": index.symbol_names(symbols), "directories": index.directories(files)}


def first_rows(df: DataFrame, most=None, order="ord") -> DataFrame:
    """The stored rows of a table: all of them, or the first ``most`` by insertion order."""
    return df if most is None else ordering.top(df, (order,), most)


def fingerprint(files: DataFrame) -> DataFrame:
    """Number of files and two sums of digests of all paths with their lengths: one aggregate, whatever the order of rows."""
    digest = F.md5(F.concat_ws("|", "path", F.length("content").cast("string")))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")).cast("string")
    return files.agg(F.concat_ws(":", F.count("*").cast("string"), part(1), part(9)).alias("fingerprint"))


def metadata(files: DataFrame, symbols: DataFrame, workspace: str) -> DataFrame:
    return fingerprint(files).select(
        F.lit(VERSION).alias("version"), F.lit(workspace).alias("workspace"), F.current_timestamp().alias("last_built"), "fingerprint",
        files.agg(F.count("*")).scalar().alias("file_count"), symbols.agg(F.count("*")).scalar().alias("symbol_count"))


def fresh(workspace, last_built, current: str, now, hours=24):
    """Built for this workspace and not older than a day."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(last_built)) / 3600
    return (workspace == current) & (age <= hours)


def is_stale(meta: DataFrame, workspace: str, now=None, hours=24) -> DataFrame:
    """One flag: nothing stored, another workspace, or older than a day."""
    at = F.current_timestamp() if now is None else now
    ok = F.max(fresh(F.col("workspace"), F.col("last_built"), workspace, at, hours).cast("int"))
    return meta.agg((F.coalesce(ok, F.lit(0)) == 0).alias("stale"))


def restore_if_same(spark, root: str, files: DataFrame, names):
    """Stored tables when the corpus still has the stored fingerprint, else None."""
    try:
        stored = spark.read.parquet(f"{root}/metadata").select("fingerprint").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    now = fingerprint(files).first()
    return load_tables(spark, root, names) if stored and stored[0] == now[0] else None


def add_files(tables: DataFrame, new_rows: DataFrame, key="path") -> DataFrame:
    """Incremental replace: drop the new files' old rows, add the new ones."""
    return tables.join(new_rows.select(key).distinct(), key, "left_anti").unionByName(new_rows)


def remove_files(tables: DataFrame, gone: DataFrame, key="path") -> DataFrame:
    return tables.join(gone.select(key), key, "left_anti")


def next_version(pages: DataFrame) -> DataFrame:
    """Version a page write would carry: highest stored version plus one."""
    return pages.groupBy("title").agg((F.max("version") + 1).alias("version"))
