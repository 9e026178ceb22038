"""Where intermediate results go, and how small tables are proven small."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A rule or label table at or under this many rows is held by every task.
SMALL_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; a local one only for a local master."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        found = tempfile.mkdtemp(prefix="listwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and cut its lineage, so loops neither recompute nor grow plans."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """``df`` written and read again. A checkpoint keeps what the planner knows of its rows; in loops that rename
    and compare columns these conditions multiply with every round, until planning takes longer than the work.
    It also holds rows unpacked, several times as large as here."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by these columns, for work that costs far more than reading its rows.

    Spark reads a small file in few tasks and also puts small partitions of a shuffle together, by their bytes;
    a number of partitions that is asked for stays. Conditions on the result are not moved below the shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by).where(F.spark_partition_id() >= 0)


def free(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames nobody refers to any more.

    Spark does so when the driver's JVM collects its garbage, which on a roomy driver may be long
    after a step of several shuffles has been written and cut off. What Python let go is known to the JVM
    only after a first collection there.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def grow(known: DataFrame, delta: DataFrame, rounds: int) -> DataFrame:
    """``known`` with the rows of one more round; now and then written anew in partitions of even
    size, as many as the data needs, so a long loop does not end in very many small ones."""
    both = known.unionByName(delta)
    return both if rounds % 4 else cut(both.hint("rebalance"))


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast table if ``df`` has at most ``max_rows`` rows, else ``df`` itself.

    At most ``max_rows + 1`` rows reach the driver. A larger table keeps its own plan and
    Spark joins it by shuffling.
    """
    found = small_or_none(df, max_rows)
    return F.broadcast(df.sparkSession.createDataFrame([], df.schema)) if found is None else found


def small_or_none(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """As ``small``, but nothing for a table without rows; a stream is not looked into."""
    if df.isStreaming:
        return df
    rows = df.limit(max_rows + 1).collect()
    if not rows:
        return None
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def table_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """In-code table (rules, prefixes, pairs): its size is known, so it is broadcast."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= SMALL_ROWS else made
