"""Order-sensitive helpers that never pull a whole table into one task."""

import tempfile
import uuid

from pyspark.sql import DataFrame, Window, functions as F


def first_by(df: DataFrame, keys, order, value_cols=None) -> DataFrame:
    """First row per key under ``order``: an aggregate, so hot keys combine before the shuffle."""
    cols = value_cols or [c for c in df.columns if c not in keys]
    order = [order] if isinstance(order, str) else list(order)
    picked = F.min_by(F.struct(*cols), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, "__row.*")


def top_per_key(df: DataFrame, keys, order, k: int, rank="rn") -> DataFrame:
    """First k rows per key; Spark trims each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top(df: DataFrame, order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def number_rows(df: DataFrame, key: str, order, name: str, start=0, buckets=200) -> DataFrame:
    """Consecutive numbers over the whole table in ``order`` (which begins with ``key``).

    The numeric key is cut at fixed quantiles; each range is numbered on its own and
    shifted by the row counts of the ranges before it.  Only the range counts (at most
    ``buckets`` rows) meet in one place.
    """
    cuts = df.select(F.percentile_approx(
        key, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    ranged = df.withColumn("__b", bucket)
    counts = {r["__b"]: r["n"] for r in ranged.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    shift, total = {}, start
    for b in sorted(counts):
        shift[b] = total
        total += counts[b]
    if not shift:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    offsets = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    w = Window.partitionBy("__b").orderBy(*order)
    return ranged.withColumn(name, (F.row_number().over(w) - 1 + offsets[F.col("__b")]).cast("bigint")).drop("__b")


def one_row_each(df: DataFrame, *keys) -> bool:
    """Whether no two rows have the same keys."""
    return df.groupBy(*keys).count().filter("count > 1").isEmpty()


def apart(df: DataFrame) -> DataFrame:
    """A side of a join whose other side also grows with the corpus: sorted and merged, never sent whole through the driver."""
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str, root=None, ranges=True) -> DataFrame:
    """``df`` written as Parquet in ranges of ``by``, sorted, and read back: a filter on ``by`` skips files and row groups.

    ``root`` is a new folder that all executors share; without it one is made in the shared folder.  Without ``ranges`` every task writes its own rows,
    sorted, so nothing is shuffled or computed twice for the ranges, and a filter skips the pages of each file.
    """
    path = root or f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    (df.repartitionByRange(by) if ranges else df).sortWithinPartitions(by).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark) -> str:
    """The checkpoint folder, set from ``spark.checkpoint.dir`` if need be; on a cluster that must be named.

    Only a session of one machine, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()
