"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words in lower case and their first four and five bytes, hashed into 2**18 buckets.
Every bucket that the sample has is a feature of the machine, 2**18 at most. It learns a weight for each
feature and a vector for each, whose products weigh every pair of features that occur together, so an
insult next to a group's name can weigh more than the two apart. Nothing is selected: a feature's weight
is scaled by how much its smoothed frequencies differ between the labels, sums by the number of a text's
features, and weights decay.

The machine is fitted on a bounded sample (``MAX_SAMPLE``) of the labelled rows, those whose id has the
least hash; that bound is what lets the sample be broadcast and fitted on the driver. Scoring reads every
whole text once, in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from listwright.llm.registry import query, table
from listwright.llm.text import LOWER, slices, span_hashes, text_column, words
from listwright.sources.storage import scratch

MAX_SAMPLE = 20_000
BITS = 18
FACTORS = 8
EPOCHS = 16
_COUNTED = 500  # texts whose terms are counted at once

# A term is a run of letters; bytes of other scripts count as letters.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[97:123] = False
_NO_LETTER[128:] = False


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of all terms, repeats included."""
    data = LOWER[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[capital] += 0x20  # À to Þ
    starts, ends, first = words(data, offsets, _NO_LETTER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, found = [row], [span_hashes(data, starts, ends, 1)]
    for size in (4, 5):
        long = ends - starts > size
        rows.append(row[long])
        found.append(span_hashes(data, starts[long], starts[long] + size, size))
    shift = np.uint64(64 - BITS)
    return np.concatenate(rows), (np.concatenate(found) >> shift).astype(np.int64)


class Machine:
    """Weights of a fitted factorization machine."""

    def __init__(self, terms: np.ndarray, bias: float, ratio: np.ndarray | None = None):
        """``ratio``: the logarithm of each term's smoothed frequency among toxic texts over that among others."""
        ratio = np.zeros(len(terms)) if ratio is None else ratio
        self.number = np.full(1 << BITS, -1, np.int64)
        self.number[terms] = np.arange(len(terms))
        self.bias = bias
        self.scale = np.abs(ratio)
        self.weights = 0.1 * np.sign(ratio)
        self.vectors = np.random.default_rng(7).normal(0, 0.1, (len(terms), FACTORS))

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` rows with the distinct features (row, feature)."""
        linear = np.bincount(row, self.weights[feature] * self.scale[feature], n)
        pairs = np.zeros(n)
        for f in range(FACTORS):
            v = self.vectors[feature, f]
            pairs += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        many = np.maximum(np.bincount(row, minlength=n), 1)
        return self.bias + linear / np.sqrt(many) + pairs / (2 * many)

    def features(self, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features of each row."""
        feature = self.number[bucket]
        there = feature >= 0
        both = np.unique(row[there] * len(self.weights) + feature[there]) if there.any() else np.zeros(0, np.int64)
        return both // max(1, len(self.weights)), both % max(1, len(self.weights))

    def fit(self, begin: np.ndarray, feature: np.ndarray, label: np.ndarray, epochs: int = EPOCHS):
        """AdaGrad on the log loss with a little weight decay; rows in a fixed random order. Row i has the
        distinct features ``feature[begin[i]:begin[i + 1]]``."""
        rng, n = np.random.default_rng(11), len(label)
        seen = [1e-6, np.full_like(self.weights, 1e-5), np.full_like(self.vectors, 1e-5)]
        size, rate, decay = 128, 0.5, 1e-4
        for _ in range(epochs):
            shuffled = rng.permutation(n)
            for at in range(0, n, size):
                some = shuffled[at : at + size]
                f = np.concatenate([feature[begin[i] : begin[i + 1]] for i in some])
                count = begin[some + 1] - begin[some]
                r = np.repeat(np.arange(len(some)), count)
                error = 1 / (1 + np.exp(-np.clip(self.logits(r, f, len(some)), -30, 30))) - label[some]
                g0 = error.mean()
                seen[0] += g0 * g0
                self.bias -= rate * g0 / np.sqrt(seen[0])
                if not len(f):
                    continue
                many = np.maximum(count, 1)
                v = self.vectors[f]
                sums = np.zeros((len(some), FACTORS))
                sums[count > 0] = np.add.reduceat(v, (np.cumsum(count) - count)[count > 0], axis=0)
                order = np.argsort(f, kind="stable")
                used, first = np.unique(f[order], return_index=True)
                g = np.add.reduceat(((error / np.sqrt(many))[r] * self.scale[f])[order], first)
                g = g / len(some) + decay * self.weights[used]
                step = (error / many)[r][:, None] * (sums[r] - v)
                gv = np.add.reduceat(step[order], first, axis=0) / len(some) + decay * self.vectors[used]
                seen[1][used] += g * g
                seen[2][used] += gv * gv
                self.weights[used] -= rate * g / np.sqrt(seen[1][used])
                self.vectors[used] -= rate * gv / np.sqrt(seen[2][used])
        return self


def _terms(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            row, bucket = buckets(*text_column(part.column("text")))
            both = np.unique(row << BITS | bucket)
            at = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], ["toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Machine:
    """A machine for ``labels(doc_id, toxic)``, of which at most ``max_sample`` ids are looked at.

    An id labelled twice counts as toxic if one of its labels is. Null ids and labels are not used.
    Without labelled texts the machine has no features and scores everything 0.25.
    """
    spark = docs.sparkSession
    known = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    path = scratch(spark, "toxicity")
    docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(
        _terms, "toxic int, terms array<int>"
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    bias = np.log((positive + 0.5) / (n - positive + 1.5))
    if not 0 < positive < n:
        return Machine(np.zeros(0, np.int64), float(bias))
    # The sample's terms: at most ``max_sample`` lists of at most 2**BITS numbers.
    sample = rows.select("toxic", "terms").toArrow().combine_chunks()
    label = sample.column("toxic").to_numpy().astype(float)
    lists = sample.column("terms").combine_chunks()
    begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    bucket = lists.flatten().to_numpy()
    toxic, every = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int64)
    for a in range(0, len(label), _COUNTED):  # some texts at a time: bincount makes wide copies
        b = min(a + _COUNTED, len(label))
        part = bucket[begin[a] : begin[b]]
        toxic += np.bincount(part, np.repeat(label[a:b], np.diff(begin[a : b + 1])), 1 << BITS)
        every += np.bincount(part, minlength=1 << BITS)
    terms = np.flatnonzero(every)
    # One text more of each label's share of every term.
    share = positive / n
    ratio = np.log((toxic[terms] + share) / (positive + 1)) - np.log((every - toxic)[terms] + 1 - share) + np.log(n - positive + 1)
    machine = Machine(terms, float(bias), ratio)
    feature = machine.number.astype(np.int32)[bucket]
    del sample, lists, bucket
    pa.default_memory_pool().release_unused()  # the driver has little room
    return machine.fit(begin, feature, label)


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, of the whole text; null and empty texts have no terms."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2**BITS features
    columns = [c for c in docs.columns if c != "score"]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    def run(batches):
        fitted = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                features = fitted.features(*buckets(*text_column(part.column("text"))))
                logits = np.clip(fitted.logits(*features, part.num_rows), -30, 30)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(1 / (1 + np.exp(-logits)))], ["row", "score"])

    out = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("score", DoubleType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "score")


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``fold``; false for null."""
    left = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(left == fold, F.lit(False))


@query("op8_toxicity")
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, folder, "labels").where(~held_out("doc_id", 5, 0)))
    return scores(docs, machine).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
