"""Session for tests and benchmarks; on a cluster the caller brings its own."""

import os

from pyspark.sql import SparkSession


def local_session(cores=None, partitions=None, memory="12g"):
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (SparkSession.builder.master(f"local[{cores}]").appName("textlode")
            .config("spark.sql.shuffle.partitions", str(partitions or cores))
            .config("spark.driver.memory", memory)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())
