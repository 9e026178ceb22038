"""Numbering and looking back inside groups of any size.

A window partitioned by the group alone sorts a whole group in one task. Here rows are
range-partitioned over the group and all order columns, so a group holding a third of the table,
also one whose rows share a position, lies in a third of the partitions; what a partition must know
of the ones before it is one row per group that its border cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.sources.storage import cut

# Below this many rows in the whole table one task can hold any group.
PLAIN_ROWS = 1_000_000


def _is_small(df: DataFrame, plain_rows: int) -> bool:
    return plain_rows > 0 and df.limit(plain_rows + 1).count() <= plain_rows


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], **more: Column) -> DataFrame:
    """Rows in order over partitions, each with its partition's number, written once, so a row keeps
    its place when an executor is lost."""
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    return cut(ranged.withColumns({"_local": F.row_number().over(local), **{n: c.over(local) for n, c in more.items()}}))


def _of_part(keys: Sequence[str], rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows (*keys, _part, …)`` under other names, and the condition that joins them."""
    renamed = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_kp"),
        *[c for c in rows.columns if c not in (*keys, "_part")],
    )
    on = F.col("_part") == F.col("_kp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return renamed, on


def sorted_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, plain_rows: int = PLAIN_ROWS
) -> DataFrame:
    """Row numbers 1, 2, 3 … per group for order keys of any sortable type, arrays included."""
    keys = list(by)
    if _is_small(df, plain_rows):
        number = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
        return df.withColumn(out, number.cast("bigint"))
    placed = _placed(df, keys, order)
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # Per group as many rows as it has partitions, fewer than the job has.
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    starts = sizes.withColumn("_start", F.sum("_n").over(earlier) - F.col("_n")).where("_start > 0").drop("_n")
    starts, on = _of_part(keys, starts)
    # At most one row per partition: only its first group can have begun before it.
    return placed.join(F.broadcast(starts), on, "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_start", F.lit(0))).cast("bigint").alias(out)
    )


row_numbers = sorted_numbers


def previous_value(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, plain_rows: int = PLAIN_ROWS
) -> DataFrame:
    """Value of the row before, per group."""
    keys = list(by)
    if _is_small(df, plain_rows):
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    placed = _placed(df, keys, order, _before=F.lag(value))
    last = placed.groupBy(*keys, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), "_local").alias("_last"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    ends = last.withColumn("_end", F.lag("_last").over(across)).where("_end IS NOT NULL").drop("_last")
    ends, on = _of_part(keys, ends)
    # At most one row per partition, as above.
    before = F.when(F.col("_local") > 1, F.col("_before")).otherwise(F.col("_end.v"))
    return placed.join(F.broadcast(ends), on, "left").select(*df.columns, before.alias(out))
