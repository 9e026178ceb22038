"""Session settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splits a hot key's join partitions also where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Files of rounds no frame refers to any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Shuffle data one task should get; many start partitions, joined up to this size at run time.
PARTITION_BYTES = 256 << 20


def cluster_session(name: str = "listwright", shuffle_bytes: int = 10 << 40) -> SparkSession:
    """Session on whatever master the submit command names, for shuffles of about ``shuffle_bytes``.

    Set ``spark.checkpoint.dir`` to a folder all executors reach.
    """
    start = min(max(shuffle_bytes // PARTITION_BYTES, 200), 100_000)
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.shuffle.partitions", str(start))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
        .config("spark.sql.files.maxPartitionBytes", str(PARTITION_BYTES))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str | None = None, name: str = "listwright") -> SparkSession:
    """Session on this machine, for tests and benchmarks."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
