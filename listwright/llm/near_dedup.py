"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

Shingles are runs of five words, weighted by how often the document has them and by how few documents
have them, counted exactly over the whole corpus: from one for a shingle of every document up to two for one
that at most a thousandth of them has. A weight depends on the share of documents alone, whatever their number.
Improved consistent weighted sampling draws, with the same random numbers for the same shingle everywhere, samples that two documents share with the probability of their weighted Jaccard similarity.
Four samples make a band; documents that share a band are candidates. Those whose samples agree too
rarely for the threshold (by four standard deviations) are left out before any text is moved, and the
others are links when the weighted Jaccard similarity of their whole texts reaches the threshold.

Documents with the same words are one node from the start, folded before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.components import linked_groups
from listwright.llm.registry import query, table
from listwright.llm.text import distinct, groups, least_reached, mix, run_hashes, slices, span_hashes, text_column, words
from listwright.sources.storage import cut, free, scratch

SHINGLE = 5
THRESHOLD = 0.8
# A shingle weighs most when no greater share of the documents has it.
RARE_SHARE = 1e-3
# Hashes that a task counts before it hands them on.
COUNTED = 4 << 20
# A pair at the threshold shares one of 12 bands of 4 with probability 0.998.
BANDS, ROWS = 12, 4
# Ids of texts to compare that are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT_IDS = 500_000
# Most rows, and total weight (about the number of shingles), of a block of a large bucket.
BLOCK_ROWS, BLOCK_WEIGHT = 512, 600_000
_STEPS = 4096  # draws of each random number, of which a hash takes one


class Sampler:
    """Weights of shingles, and the random numbers of the samples."""

    def __init__(self, often: np.ndarray, idf: np.ndarray, rare: float):
        """``idf`` of the shingles ``often``, sorted; ``rare`` of all others."""
        self.often = np.append(often, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.idf = np.append(idf, rare).astype(np.float32)
        self.rare = np.float32(rare)
        rng = np.random.default_rng(5)
        gamma = lambda: rng.gamma(2.0, 1.0, _STEPS).astype(np.float32)
        self.r, self.log_c, self.beta = gamma(), np.log(gamma()), rng.random(_STEPS).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def unit(self, found: np.ndarray) -> np.ndarray:
        """The weight of one occurrence of each shingle."""
        at = np.searchsorted(self.often, found)
        return np.where(self.often[at] == found, self.idf[at], self.rare)

    def weighted(self, data, offsets):
        """``(row, shingle, weight)`` of the distinct shingles, ordered by row; and hashes of all words."""
        row, found, whole = shingles(data, offsets)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(row))).astype(np.float32)
        found = found[at]
        return row[at], found, times * self.unit(found), whole

    def samples(self, row, found, weight, n) -> np.ndarray:
        """32 bits of each sample, ``n`` rows of them; rows without shingles have zeros."""
        out = np.zeros((n, BANDS * ROWS), np.uint64)
        if not len(row):
            return out
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        log_w = np.log(weight)
        low = np.uint64(0xFFFFFFFF)
        for k, seed in enumerate(self.seeds):
            u = found * seed
            u ^= u >> np.uint64(32)
            u *= np.uint64(0xD6E8FEB86659FD93)
            r = self.r[(u >> np.uint64(52)).astype(np.int64)]
            beta = self.beta[((u >> np.uint64(40)) & np.uint64(_STEPS - 1)).astype(np.int64)]
            log_c = self.log_c[((u >> np.uint64(28)) & np.uint64(_STEPS - 1)).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            # The logarithm of a, made positive so that its bits are ordered like it.
            log_a = np.clip(log_c - r * (t - beta) - r, -120, 120) + np.float32(128)
            mark = (u ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & low
            least = np.minimum.reduceat(log_a.view(np.uint32).astype(np.uint64) << np.uint64(32) | mark, begin)
            out[row[begin], k] = least & low
        return out

    @staticmethod
    def bands(samples: np.ndarray) -> np.ndarray:
        """A hash for each band's samples."""
        out = np.zeros((len(samples), BANDS), np.uint64)
        for k in range(BANDS * ROWS):
            band = k // ROWS
            out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + samples[:, k] + np.uint64(k + 1))
        return out


def shingles(data, offsets, size: int = SHINGLE):
    """``(row, hash)`` of all runs of ``size`` words, a shorter text being one; hashes of all words."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    count = np.diff(first)
    n = len(count)
    row = np.repeat(np.arange(n), count)
    runs = run_hashes(hashes, size)
    inside = np.flatnonzero(np.arange(len(runs)) + size <= first[row[: len(runs)] + 1])
    # The whole text as two numbers, from its words in order.
    nth = (np.arange(len(row)) - first[row]).astype(np.uint64)
    whole = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(count)
    for side in (0, 1):
        spread = mix(hashes ^ mix(nth * np.uint64(2) + np.uint64(side)))
        if len(full):
            whole[full, side] = np.add.reduceat(spread, first[:-1][full])
    short = np.flatnonzero((count > 0) & (count < size))
    return (
        np.concatenate([row[inside], short]),
        np.concatenate([runs[inside], mix(whole[short, 0])]),
        whole,
    )


def _document_counts(batches):
    """How many documents have each shingle, counted together for some documents at a time."""

    def counted(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["shingle", "n"])

    held, many = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            row, found, _ = shingles(*text_column(part.column("text")))
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            held.append(found[new])
            many += len(held[-1])
            if many > COUNTED:
                yield counted(held)
                held, many = [], 0
    if many:
        yield counted(held)


def fit_weights(docs: DataFrame, rare_share: float = RARE_SHARE) -> Sampler:
    """Inverse document frequencies over all documents: ``1 + ln(share) / ln(rare_share)``, two at most.

    ``share`` is that of the documents that have a shingle, counted exactly, so a corpus repeated any number
    of times has the same weights. Only shingles of a greater share than ``rare_share`` are sent to the tasks;
    of these there are fewer than the mean number of shingles a document over ``rare_share``.
    """
    spark = docs.sparkSession
    total = docs.count()
    path = scratch(spark, "counts")
    counts = docs.select("text").mapInArrow(_document_counts, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts.where(F.col("n") > max(1.0, rare_share * total)).write.parquet(path)
    free(spark)
    found = spark.read.parquet(path).toArrow()
    often, n = (found.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(often.view(np.uint64))
    # Not less than one: what a crowd of near copies shares must not weigh next to nothing.
    idf = lambda n: 1 + np.minimum(1, np.log(n / max(1, total)) / np.log(rare_share))
    return Sampler(often.view(np.uint64)[order], idf(n[order]), float(idf(1)))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, component_id, kept)``, one row per input row: the smallest id linked with its own.

    Texts of fewer than five words have one shingle, all of their words; texts without words (null,
    empty, white space) link with nothing. Rows with one doc_id are one document and all kept or all
    not. A null doc_id is in no group, its component_id is null, and it is kept.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sampler = spark.sparkContext.broadcast(fit_weights(docs))  # bounded by RARE_SHARE

    def signatures(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, found, weight, whole = sampler.value.weighted(*text_column(part.column("text")))
                n = part.num_rows
                samples = sampler.value.samples(row, found, weight, n)
                bands = sampler.value.bands(samples).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, np.int32)), pa.array(bands.ravel()))
                marks = samples.astype(np.uint32).view(np.int32)
                places = np.arange(0, marks.size + 1, BANDS * ROWS, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(whole[:, 0].view(np.int64)),
                        pa.array(whole[:, 1].view(np.int64)),
                        pa.array(np.bincount(row, minlength=n) > 0),
                        pa.array(np.bincount(row, weight, n)),
                        lists,
                        pa.ListArray.from_arrays(pa.array(places), pa.array(marks.ravel())),
                    ],
                    ["doc_id", "one", "two", "full", "weight", "bands", "samples"],
                )

    path = scratch(spark, "signatures")
    docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(
        signatures, "doc_id bigint, one bigint, two bigint, full boolean, weight double, bands array<bigint>, samples array<int>"
    ).write.parquet(path)
    signed = spark.read.parquet(path).where("full")
    # Of documents with the same words the least id stands for all.
    same = signed.groupBy("one", "two").agg(F.min("doc_id").alias("id"))
    nodes = same.join(signed, ["one", "two"]).where("doc_id = id").dropDuplicates(["id", "one", "two"])
    members = nodes.select("id", F.posexplode("bands").alias("band", "hash")).select(
        F.xxhash64("band", "hash").alias("bucket"), "id"
    )
    known = cut(nodes.select("id", "weight", "samples"))
    links = linked_groups(
        cut(members.distinct()),
        lambda pairs: _verified(docs, pairs, known, sampler, threshold),
        lambda buckets: _in_blocks(docs, buckets, known, sampler, threshold),
    )
    copies = signed.join(same, ["one", "two"]).select("doc_id", "id").distinct()
    # A document is in the group of the node that stands for it.
    named = copies.join(links.withColumnRenamed("node", "id"), "id", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "id")).alias("component_id")
    )
    back = named.select(F.col("doc_id").alias("_id"), "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id")))
    return docs.select("doc_id").join(back, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _verified(docs, pairs, known, sampler, threshold) -> DataFrame:
    """The pairs whose whole texts' weighted Jaccard similarity is at least ``threshold``.

    The similarity is at most the ratio of the total weights, and is the chance of each sample to agree,
    so pairs too unlike in either are left out before any text is moved.
    """
    spark = docs.sparkSession
    for end in ("a", "b"):
        pairs = pairs.join(known.select(*[F.col(c).alias(n) for c, n in (("id", end), ("weight", f"w{end}"), ("samples", f"s{end}"))]), end)
    close = (F.col("wa") >= 0.999 * threshold * F.col("wb")) & (F.col("wb") >= 0.999 * threshold * F.col("wa"))
    many = BANDS * ROWS
    least = math.floor(many * threshold - 4 * math.sqrt(many * threshold * (1 - threshold)))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    path = scratch(spark, "pairs")
    pairs.where(close & (agree >= least)).select("a", "b").distinct().write.parquet(path)
    pairs = spark.read.parquet(path)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _texts_of(docs, wanted)
    a = texts.select(F.col("doc_id").cast("bigint").alias("a"), F.col("text").alias("text"))
    b = texts.select(F.col("doc_id").cast("bigint").alias("b"), F.col("text").alias("other"))

    def alike(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for some in slices(part, "other", 1 << 20):
                    good = similarities(sampler.value, some.column("text"), some.column("other")) >= threshold
                    at = pa.array(np.flatnonzero(good))
                    yield pa.RecordBatch.from_arrays([some.column("a").take(at), some.column("b").take(at)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text", "other").mapInArrow(alike, "a bigint, b bigint").distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the given ids, written once."""
    path = scratch(docs.sparkSession, "texts")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    docs.join(ids, "doc_id", "left_semi").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _in_blocks(docs, buckets, known, sampler, threshold) -> DataFrame:
    """Links within ``buckets(bucket, id, own)``, some for all.

    A bucket is cut into blocks of bounded rows and shingles, and every pair of blocks is compared in one
    matrix product, so a document moves once per block and no pair of documents is written out. Pairs of
    one group are left out; of the others' links, one per document is given.
    """
    sized = buckets.join(known.groupBy("id").agg(F.sum("weight").alias("weight")), "id")
    sizes = sized.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("weight") / BLOCK_WEIGHT)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    pieces = (
        buckets.join(sizes, "bucket")
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "own")
    )
    texts = _texts_of(docs, buckets.select(F.col("id").alias("doc_id")).distinct())
    with_text = pieces.join(texts.select(F.col("doc_id").cast("bigint").alias("id"), "text"), "id")

    def compare(batches):
        for part in groups(batches, ["bucket", "left", "right"]):
            ids, own, block = (np.asarray(part.column(n), np.int64) for n in ("id", "own", "block"))
            # A pair within one block is looked at where that block meets itself.
            aside = block if part.column("left")[0].as_py() != part.column("right")[0].as_py() else None
            i, j = linked_pairs(sampler.value, part.column("text"), own, aside, threshold)
            if len(i):
                least = least_reached(ids, i, j)
                some = np.flatnonzero(least != ids)
                yield pa.RecordBatch.from_arrays([pa.array(least[some]), pa.array(ids[some])], ["a", "b"])

    return (
        with_text.repartition("bucket", "left", "right")
        .sortWithinPartitions("bucket", "left", "right")
        .mapInArrow(compare, "a bigint, b bigint")
        .distinct()
    )


def linked_pairs(sampler: Sampler, texts: pa.Array, own: np.ndarray, aside: np.ndarray | None, threshold: float):
    """Places of all pairs of texts, of other ``own`` (and ``aside``), that reach the threshold."""
    n = len(texts)
    parts = [sampler.weighted(*text_column(p.column(0)))[:3] for p in slices(pa.record_batch([texts], ["text"]), "text")]
    sizes = [p.num_rows for p in slices(pa.record_batch([texts], ["text"]), "text")]
    begin = np.cumsum([0, *sizes])
    row = np.concatenate([r + b for (r, _, _), b in zip(parts, begin)])
    found = np.concatenate([f for _, f, _ in parts])
    weight = np.concatenate([w for _, _, w in parts])
    total = np.bincount(row, weight, n)
    # min(a, b) of two multiples of one frequency is a product of unary digits: the shingle, its second
    # occurrence, and so on, each weighing one frequency.
    unit = sampler.unit(found)
    times = np.rint(weight / unit).astype(np.int64)
    digit = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    row, unit = np.repeat(row, times), np.repeat(unit, times)
    keys, _, column = distinct(mix(np.repeat(found, times) + digit.astype(np.uint64)))
    often = np.bincount(column, minlength=len(keys)) > 1  # what one text alone has is in no intersection
    keep = often[column]
    row, unit, column = row[keep], np.sqrt(unit[keep]), (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, unit, column = row[order], unit[order], column[order]
    both = np.zeros((n, n), np.float32)
    step = max(256, (4 << 20) // max(1, n))
    for first in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [first, first + step])
        some = np.zeros((n, step), np.float32)
        some[row[a:b], column[a:b] - first] = unit[a:b]
        both += some @ some.T
    i, j = np.nonzero(np.triu(both >= (threshold - 1e-4) * (total[:, None] + total[None, :] - both), 1))
    apart = own[i] != own[j]
    if aside is not None:
        apart &= aside[i] != aside[j]
    i, j = i[apart], j[apart]
    # Pairs that the single precision cannot decide are computed like all others.
    exact = both[i, j] / np.maximum(total[i] + total[j] - both[i, j], 1e-30)
    near = np.flatnonzero(np.abs(exact - threshold) < 1e-4)
    for at in near.tolist():
        one = similarities(sampler, texts.slice(int(i[at]), 1), texts.slice(int(j[at]), 1))
        exact[at] = one[0]
    good = exact >= threshold
    return i[good], j[good]


def similarities(sampler: Sampler, left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two columns, row by row."""
    n = len(left)
    sides = []
    for column in (left, right):
        row, found, weight, _ = sampler.weighted(*text_column(column))
        sides.append((mix(found ^ mix(row.astype(np.uint64) + np.uint64(1))), row, weight))
    _, at, to = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    both = np.bincount(sides[0][1][at], np.minimum(sides[0][2][at], sides[1][2][to]), n)
    total = sum(np.bincount(row, weight, n) for _, row, weight in sides)
    return both / np.maximum(total - both, 1e-30)


@query("op7_minhash_near_dedup")
def op7(spark, folder):
    return near_groups(table(spark, folder, "documents"))
