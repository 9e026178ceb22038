"""Exact deduplication with a split for heavy hitters.

Each document becomes a digest of its text, white space made alike. Misra-Gries summaries, one per
task, name the digests that may be frequent; those are counted exactly, and as there are at most
``counters`` + 1 of them, the counted winners are broadcast and their documents decided without a
shuffle. What remains has no frequent digest, so an ordinary shuffle by digest spreads evenly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.registry import query, table
from listwright.sources.storage import cut

COUNTERS = 1000


def normalised(text) -> F.Column:
    """Text with every run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(items: Iterator[list], counters: int) -> Counter:
    """At most ``counters`` items with counts too low by at most 1/(counters + 1) of all items."""
    kept: Counter = Counter()
    for some in items:
        kept.update(some)
        if len(kept) > counters:
            less = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({k: v - less for k, v in kept.items() if v > less})
    return kept


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Null text counts as empty, empty texts are equal to each other. A repeated doc_id is counted as
    often as it occurs, and all its rows are kept if it is the smallest. A null doc_id never is
    keep_id unless all of a group's ids are null, which are then all kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    digests = cut(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")))

    def summaries(batches):
        found = misra_gries((b.column(0).to_pylist() for b in batches), counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "n"]
        )

    total = digests.count()
    # The counts of all summaries sum up to at most ``total``, so at most counters + 1 digests pass.
    maybe = (
        digests.select("digest")
        .mapInArrow(summaries, "digest binary, n bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > total // (counters + 1))
        .select("digest")
    )
    # Bounded, see above; counted exactly map-side before the shuffle.
    counted = (
        digests.join(F.broadcast(maybe), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .collect()
    )
    winners = F.broadcast(
        spark.createDataFrame(
            [(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in counted],
            f"digest binary, keep_id {docs.schema['doc_id'].dataType.simpleString()}, group_size bigint",
        )
    )
    heavy = digests.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(winners.select("digest"), "digest", "left_anti").select(
        "digest", "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op3_exact_dedup", SQL)
def op3(spark, folder):
    return exact_groups(table(spark, folder, "documents"))
