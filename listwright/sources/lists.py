"""Long JSON lists: one file, read by many tasks.

A file that holds one list is usually one line, which a line reader gives to one task. Here it is cut
at commas instead, which Spark does block by block, and the commas that stand between items are
told from all others by what was opened and closed before them. Two facts about a stretch of text
are enough for that and combine: whether it ends inside a string, and how far it goes up or down in
nesting, for either way it may begin. Stretches are summed within a block by a running sum, and blocks
of a file by another over one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.sources.storage import cut, scratch


def _nesting(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.regexp_replace(text, r"[^\[{]+", "")) - F.length(F.regexp_replace(text, r"[^\]}]+", ""))


def _facts(value: Column) -> list[Column]:
    """``odd``: 1 if the text has an odd number of quotes; ``out`` and ``ins``: its nesting when it begins
    outside a string, and inside one. An escape has no comma, so no cut parts one."""
    bare = F.regexp_replace(value, r"\\.", "")
    strings = r'"[^"]*("|\z)'
    return [
        F.pmod(F.length(F.regexp_replace(bare, r'[^"]+', "")), F.lit(2)).alias("odd"),
        _nesting(F.regexp_replace(bare, strings, "")).alias("out"),
        _nesting(F.regexp_replace(F.concat(F.lit('"'), bare), strings, "")).alias("ins"),
    ]


def read_json_list(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``(file, item_no, item)``: the items, numbered from 1, of the list ``[item, …]`` that each file holds.

    A file that holds anything else is one item. Items are text as written, without white space around
    them. Empty files and empty lists have no items. An item must fit in a row; a list need not.
    """
    path = scratch(spark, "fragments")
    read = spark.read.option("lineSep", ",").text(paths if isinstance(paths, str) else list(paths))
    read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        *_facts(F.col("value")),
    ).write.parquet(path)
    parts = spark.read.parquet(path)
    by_block = Window.partitionBy("file", "block").orderBy("at")
    by_file = Window.partitionBy("file").orderBy("block")
    before, earlier = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by_block, by_file))

    def parity(column: str, window) -> Column:
        return F.coalesce(F.pmod(F.sum(column).over(window), F.lit(2)), F.lit(0))

    # Each block by itself, for a beginning outside a string and one inside.
    seen = cut(parts.withColumn("odd_before", parity("odd", before)))
    even = F.col("odd_before") == 0
    blocks = seen.groupBy("file", "block").agg(
        F.pmod(F.sum("odd"), F.lit(2)).alias("block_odd"),
        F.sum(F.when(even, F.col("out")).otherwise(F.col("ins"))).alias("block_out"),
        F.sum(F.when(even, F.col("ins")).otherwise(F.col("out"))).alias("block_in"),
        F.min_by("value", "at").alias("head"),
    )
    # Then what holds where a block begins.
    blocks = blocks.withColumn("start_odd", parity("block_odd", earlier)).withColumn(
        "moved", F.when(F.col("start_odd") == 0, F.col("block_out")).otherwise(F.col("block_in"))
    )
    starts = blocks.select(
        "file", "block", "start_odd",
        F.coalesce(F.sum("moved").over(earlier), F.lit(0)).alias("start_depth"),
        F.first("head").over(by_file).rlike(r"\A\s*\[").alias("is_list"),
    )
    inside = F.pmod(F.col("odd_before") + F.col("start_odd"), F.lit(2)) == 1
    known = (
        seen.join(starts, ["file", "block"])
        .withColumn("inside", inside)
        .withColumn("step", F.when(F.col("inside"), F.col("ins")).otherwise(F.col("out")))
        .withColumn("depth", F.col("start_depth") + F.coalesce(F.sum("step").over(before), F.lit(0)))
        # The first item stands behind the bracket, all others behind a comma outside of anything else.
        .withColumn("begins", (F.col("is_list") & ~F.col("inside") & (F.col("depth") == 1)).cast("int"))
        .withColumn("begun", F.sum("begins").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    )
    known = cut(known.select("file", "block", "at", "value", "is_list", "begins", "begun"))
    counts = known.groupBy("file", "block").agg(F.sum("begins").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun_before")
    )
    items = (
        known.join(counts, ["file", "block"])
        .groupBy("file", (1 + F.col("begun_before") + F.col("begun")).alias("item_no"))
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("all"), F.first("is_list").alias("is_list"))
        .select("file", "item_no", "is_list", F.array_join(F.col("all.value"), ",").alias("item"))
    )
    ends = items.groupBy("file").agg(F.max("item_no").alias("last"))
    first, last = F.col("is_list") & (F.col("item_no") == 1), F.col("is_list") & (F.col("item_no") == F.col("last"))
    opened = F.when(first, F.regexp_replace("item", r"\A\s*\[", "")).otherwise(F.col("item"))
    closed = F.when(last, F.regexp_replace(opened, r"\]\s*\z", "")).otherwise(opened)
    trimmed = F.regexp_replace(closed, r"\A\s+|\s+\z", "")
    return items.join(ends, "file").select("file", "item_no", trimmed.alias("item")).where("item <> ''")
