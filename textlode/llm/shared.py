"""Small helpers of the training-data operators."""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the folder that ``spark.checkpoint.dir`` names: computed once, safe against lost executors.

    A folder of this machine is taken only where the setting is missing and the master is local, as in tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` if it is not set yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark, name) -> str:
    """A path under the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows (.., n) of highest count, at most ``most`` of them.

    The cut is a count class (quarter powers of two) taken from a histogram of a few hundred rows: no sort, and no task that sees all rows.
    """
    classed = counts.withColumn("class", F.floor(F.log2("n") * 4).cast("int"))
    classes = sorted(((r["class"], r["k"]) for r in classed.groupBy("class").agg(F.count("*").alias("k")).collect()), reverse=True)
    total, lowest = 0, None
    for c, k in classes:
        total += k
        if total > most:
            break
        lowest = c
    return (classed.limit(0) if lowest is None else classed.filter(F.col("class") >= lowest)).drop("class")


#: Low bits of a hash that a bitmap tells apart: 4 MB, whatever the number of hashes.
BITS = 25


def bitmap(keys: DataFrame) -> np.ndarray:
    """The low ``BITS`` bits of the hashes (h) as a bitmap of ``2**BITS`` bits; one row for each 32,768 of them comes to the driver."""
    place = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for b, bits in zip(rows.column("b").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[(b - 1) * 4096:b * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys a bitmap holds: all that were put in, and a few others."""
    low = keys & np.uint64((1 << BITS) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Rows of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 2000


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches, after which a worker gives its free memory back.

    Workers stay between tasks and share an executor's memory with the JVM, so what the C library keeps would add up over a job's stages.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df.sparkSession.conf.set(key, str(min(int(df.sparkSession.conf.get(key)), BATCH_ROWS)))

    def bounded(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def release():
    """Free memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
