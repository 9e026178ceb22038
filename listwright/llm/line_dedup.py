"""Fuzzy line deduplication: MinHash of character runs, banding, exact Jaccard, union-find.

All lines are compared by their runs of five characters. Each distinct line is written once; a pass over these
draws 72 MinHash values of every line's runs: of all runs of a short line, of longer runs at anchors (behind white
space and punctuation) of a long one. Lines that share a band of draws are candidates, and links if the exact
Jaccard similarity of their sets of all runs of five reaches the threshold; union-find over the links leaves one
line per component, its first by (doc_id, place).

All of it are DataFrame operations. ``similarities`` and ``linked_pairs`` are the same comparison in numpy, for
lines that one machine holds; the operator does not use them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.boundaries import code_points
from listwright.llm.components import linked_groups
from listwright.llm.registry import query, table
from listwright.llm.text import distinct as numbered
from listwright.llm.text import mix, run_hashes, span_hashes, text_column
from listwright.sources.storage import cut, free, scratch

SHINGLE = 5
THRESHOLD = 0.8
# A pair at the threshold shares one of 14 bands of five with probability 0.996. Of the longer runs at anchors it
# shares two thirds if its differences are single characters apart, and one of 18 bands of four with 0.98; more of
# them otherwise (at a similarity of 0.85: 0.998).
DRAWS, ROWS, FAR_ROWS = 72, 5, 4
# Anchors are the start and all places behind these characters. The runs there are longer, so that unlike lines
# seldom share one.
_ANCHOR, LONGER = "[ \\t!\"'(),\\-./:;?_=&#27]", 3
# A line with fewer anchored runs is drawn from all its runs, one of at least so many from these; some are both.
MANY_ANCHORED, FEW_ANCHORED = 20, 12
# Parts in which buckets are dealt, one after the other.
PARTS = 2
# Ids of lines to compare that are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT_IDS = 500_000

# Least of these is the row that stays; rows without an id come last.
_PLACE = ["late", "doc_id", "line_no", "text_hash"]


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, line_no, line, k1, k2, late)`` of all lines that have more than white space,
    trimmed; two independent 64-bit hashes name a line."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split).alias("line_no", "line"))
        .withColumn("line", F.trim("line", F.lit(" \t\x0b\x0c\r")))
        .where("line != ''")
        .withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})
        .withColumn("late", F.col("doc_id").isNull())
    )


def _distinct_lines(docs: DataFrame) -> DataFrame:
    """``(k1, k2, id, first, n, line)``: every distinct line once, with its first place and its places' number."""
    spark = docs.sparkSession
    path = scratch(spark, "lines")
    found = lines(docs).groupBy("k1", "k2").agg(
        F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line")
    )
    found.withColumn("id", F.monotonically_increasing_id()).write.parquet(path, compression="zstd")
    del found
    free(spark)
    return spark.read.parquet(path)


def runs(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of all runs of ``size`` characters, ordered by row; a shorter line is one run."""
    starts, points = code_points(data)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    found = run_hashes(mix(points.astype(np.uint64) + np.uint64(1)), size)
    inside = np.flatnonzero(np.arange(len(found)) + size <= first[row[: len(found)] + 1])
    row, found = row[inside], found[inside]
    short = np.flatnonzero(count < size)
    if len(short):
        row = np.concatenate([row, short])
        found = np.concatenate([found, span_hashes(data, offsets[short], offsets[short + 1], 1)])
        order = np.argsort(row, kind="stable")
        row, found = row[order], found[order]
    return row, found


def _runs_of(text, size: int) -> F.Column:
    """All runs of ``size`` code points of a text column; none of a shorter text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def _draws(hashed: DataFrame) -> DataFrame:
    """``(id, far, r0, …)``: every draw orders the runs by another number; one hash turned by 16 bits gives four."""
    more = [F.xxhash64("run", F.lit(k)).alias(f"h{k}") for k in range(DRAWS // 4)]
    turned = [f"shiftleft(h{k}, {t}) | shiftrightunsigned(h{k}, {64 - t})" if t else f"h{k}" for k in range(DRAWS // 4) for t in (0, 16, 32, 48)]
    return hashed.select("id", "far", *more).groupBy("id", "far").agg(*[F.min(F.expr(x)).alias(f"r{k}") for k, x in enumerate(turned)])


def _signatures(distinct: DataFrame, size: int) -> DataFrame:
    """``(id, buckets)``: a hash of every band's draws, for each way a line's runs are drawn."""
    spark = distinct.sparkSession
    # What is used more than once is a lambda's argument, so that it is evaluated once.
    anchored = F.array_distinct(
        F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(f"(?s){_ANCHOR}(?=(.{{{size + LONGER}}}))"), F.lit(1))
    )
    none = F.array().cast("array<string>")
    drawn = F.transform(
        F.array(anchored),
        lambda some: F.concat(
            F.when(F.size(some) >= FEW_ANCHORED, some).otherwise(none),
            F.when(F.size(some) < MANY_ANCHORED, _runs_of(F.col("line"), size)).otherwise(none),
        ),
    )[0]
    # Lines are dealt by id, so that all draws of one are made, and put together, in one task.
    found = distinct.select("id", "line").repartition("id").select("id", drawn.alias("runs"))
    # Of a plain explode Spark infers that there is a run, and cuts all runs once more below the shuffle to know it.
    found = found.select("id", F.explode_outer("runs").alias("run")).where("run IS NOT NULL")
    draws = _draws(found.select("id", (F.char_length("run") > size).alias("far"), F.xxhash64("run").alias("run")))
    rows = F.when(F.col("far"), FAR_ROWS).otherwise(ROWS)
    buckets = F.transform(
        F.array(F.array(*[f"r{k}" for k in range(DRAWS)])),
        lambda all_: F.transform(
            F.sequence(F.lit(0), F.when(F.col("far"), DRAWS // FAR_ROWS).otherwise(DRAWS // ROWS) - 1),
            lambda k: F.xxhash64("far", k, F.slice(all_, k * rows + 1, rows)),
        ),
    )[0]
    made = cut(draws.select("id", buckets.alias("buckets")))
    del found, draws
    free(spark)
    return made


def _run_sets(column: pa.Array, size: int) -> tuple[np.ndarray, int]:
    """Each row's distinct runs, sorted: the row in the upper bits, as many as are given, and its hash."""
    bits = max(1, len(column) - 1).bit_length()
    row, found = runs(*text_column(column), size)
    keys = np.sort(row.astype(np.uint64) << np.uint64(64 - bits) | found >> np.uint64(bits))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])], bits


def similarities(left: pa.Array, right: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of the runs of the lines of two columns, row by row."""
    (x, bits), (y, _) = (_run_sets(column, size) for column in (left, right))
    every = np.sort(np.concatenate([x, y]))
    twice = every[1:][every[1:] == every[:-1]]
    both, all_ = (np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=len(left)) for keys in (twice, every))
    return both / (all_ - both)


def _hashed_runs(text: str, size: int) -> F.Column:
    """64-bit hashes of all runs of ``size`` code points of a text column, each of which has four bytes here."""
    points = F.transform(
        F.array(F.encode(text, "UTF-32")),
        lambda b: F.when(
            F.octet_length(b) >= 4 * size,
            F.transform(F.sequence(F.lit(1), F.octet_length(b) - (4 * size - 1), F.lit(4)), lambda i: F.xxhash64(b.substr(i, F.lit(4 * size)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return points[0]


def _lines_of(distinct: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, line, n)`` of the given ids with the number of their different runs, written once."""
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    found = distinct.select("id", "line").join(ids, "id", "left_semi")
    return cut(found.withColumn("n", F.size(F.array_distinct(_hashed_runs("line", size)))))


def _verified(distinct: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose lines' runs have a Jaccard similarity of at least ``threshold``."""
    texts = _lines_of(distinct, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size)
    a = texts.select(F.col("id").alias("a"), F.col("line").alias("text"), F.col("n").alias("x"))
    b = texts.select(F.col("id").alias("b"), F.col("line").alias("other"), F.col("n").alias("y"))
    # Lines share no more runs than the one with fewer has, so most unlike lines need not be cut.
    asked = (F.col("x") + F.col("y")) * F.lit(threshold) - 1e-9
    possible = F.least("x", "y") * F.lit(1 + threshold) >= asked
    both = F.size(F.array_intersect(_hashed_runs("text", size), _hashed_runs("other", size)))
    return pairs.join(a, "a").join(b, "b").where(possible & (both * F.lit(1 + threshold) >= asked)).select("a", "b")


def linked_pairs(column: pa.Array, own: np.ndarray, aside: np.ndarray | None, size: int, threshold: float):
    """Places of all pairs of lines, of other ``own`` (and ``aside``), that reach the threshold: what they
    share is a matrix product over the runs that more than one line has."""
    n = len(column)
    sets, bits = _run_sets(column, size)
    row = (sets >> np.uint64(64 - bits)).astype(np.int64)
    total = np.bincount(row, minlength=n).astype(np.float64)
    keys, _, place = numbered(sets << np.uint64(bits))
    often = np.bincount(place, minlength=len(keys)) > 1
    keep = often[place]
    row, place = row[keep], (np.cumsum(often) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((n, n), np.float32)
    step = min(max(256, (4 << 20) // max(1, n)), max(1, int(often.sum())))
    for first in range(0, int(often.sum()), step):
        a, b = np.searchsorted(place, [first, first + step])
        some = np.zeros((n, step), np.float32)
        some[row[a:b], place[a:b] - first] = 1
        both += some @ some.T
    i, j = np.nonzero(np.triu(both * (1 + threshold) >= threshold * (total[:, None] + total[None, :]) - 1e-9, 1))
    apart = own[i] != own[j]
    if aside is not None:
        apart &= aside[i] != aside[j]
    return i[apart], j[apart]


def _linked(distinct: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(node, component)`` of the lines that are linked."""
    signatures = _signatures(distinct, size)
    members = [
        signatures.select(F.explode("buckets").alias("bucket"), "id").where(F.pmod("bucket", F.lit(PARTS)) == k) for k in range(PARTS)
    ]
    return linked_groups(members, lambda pairs: _verified(distinct, pairs, size, threshold))


def line_groups(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_hash, line_no, first_doc_id, first_line_no, kept)``, one row per line.

    Lines are cut at ``\\n`` and compared without white space around them; lines of white space alone
    are in no group and not returned. A line shorter than a run equals only itself. The first line of a
    group, by doc_id and then place, is kept; null ids come last. Rows that repeat doc_id and text keep
    the same lines. Null text has no lines. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    distinct = _distinct_lines(docs)
    found = _linked(distinct, size, threshold).withColumnRenamed("node", "id")
    linked = cut(distinct.select("id", "k1", "k2", "first").join(found, "id"))
    firsts = linked.groupBy("component").agg(F.min("first").alias("stays"))
    moved = linked.join(firsts, "component").select("k1", "k2", "stays")
    # Of lines that occur twice or are linked; the first of a component is no later than a line's own first place.
    repeated = distinct.where("n > 1").select("k1", "k2", F.col("first").alias("stays"))
    stays = cut(moved.unionByName(repeated).groupBy("k1", "k2").agg(F.min("stays").alias("stays")))
    every = lines(docs).select("k1", "k2", *_PLACE).join(stays, ["k1", "k2"], "left")
    alone = F.col("stays").isNull()
    return every.select(
        "doc_id",
        "text_hash",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("first_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("stays.line_no")).alias("first_line_no"),
        (alone | (F.col("stays") == F.struct(*_PLACE))).alias("kept"),
    )


def without_repeats(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of ``text``; all rows stay.

    Texts that lose nothing keep every byte. ``n_chars``, if there, is that of the new text.
    """
    columns = docs.columns
    repeats = line_groups(docs, size, threshold).where("NOT kept")
    gone = repeats.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("line_no").alias("_gone")
    )
    row = docs.select(
        "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("_row")
    ).withColumn("_text_hash", F.xxhash64("text"))
    both = row.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    parts = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    )
    out = parts.withColumn("_left", left)
    chars = F.length("_left").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None
    return out.select(
        *[
            F.col("_left").alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c)
            for c in columns
        ]
    )


@query("op6_line_dedup")
def op6(spark, folder):
    return line_groups(table(spark, folder, "documents"))
