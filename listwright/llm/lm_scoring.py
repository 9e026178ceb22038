"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted over the whole training part. The 767 most frequent words and the end of text are
classes of their own; all other words share 256 classes by their last three bytes, and within such a
class a word has its share of the counts, one more for each word and one for any unknown word. The
neural model gives the class from the two classes before it: their vectors, weighted by position, are
multiplied with the class's vector. Noise-contrastive estimation trains it in every task on all of the
task's text; the tasks' parameters are averaged after each round.

As a score is the sum of two products of a context and a target, all pairs' products are two matrices,
and the normaliser of every pair of contexts is one more matrix product, so each token's normalised
probability is looked up. Counts of frequent words are sent to the tasks (``FREQUENT`` of them); a text's
other words are joined with the table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.registry import query, table
from listwright.llm.text import LOWER, distinct, slices, span_hashes, text_column, words
from listwright.llm.toxicity import held_out
from listwright.sources.storage import scratch

FREQUENT = 1 << 17
WORD_CLASSES = 767
GROUP_BITS = 8
FACTORS = 24
NOISE = 32
BATCH = 2048
ROUNDS = 2
RATE = 0.1
END = np.uint64(0x656E64)  # stands for the end of a text; no word's hash but by chance
_MERGE = 1_000_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, group)`` of all tokens in order; every row's last is its end."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n = len(offsets) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(n), count + 1)
    hashes = np.full(len(row), END, np.uint64)
    groups = np.zeros(len(row), np.int64)
    to = np.arange(len(starts)) + np.repeat(np.arange(n), count)
    hashes[to] = span_hashes(data, starts, ends)
    tails = span_hashes(data, np.maximum(starts, ends - 3), ends, 3)
    groups[to] = (tails >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    return row, hashes, groups


def _counted(batches):
    """Words and how often this task has them; a word may come in several rows."""
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged():
        hashes, groups, counts = (np.concatenate(x) for x in zip(*kept))
        keys, at, which = distinct(hashes)
        return keys, groups[at], np.bincount(which, counts, len(keys)).astype(np.int64)

    def rows(some):
        return pa.RecordBatch.from_arrays(
            [pa.array(some[0].view(np.int64)), pa.array(some[1].astype(np.int32)), pa.array(some[2])], ["word", "tail", "n"]
        )

    for batch in batches:
        for part in slices(batch, "text"):
            _, hashes, groups = tokens(*text_column(part.column("text")))
            keys, at, which = distinct(hashes)
            kept.append((keys, groups[at], np.bincount(which, minlength=len(keys))))
            size += len(keys)
            if size > _MERGE:
                kept = [merged()]
                size = len(kept[0][0])
                if size > _MERGE // 2:
                    yield rows(kept[0])
                    kept, size = [], 0
    if kept:
        yield rows(merged())


class Model:
    """Vocabulary, counts and parameters; as large for any corpus."""

    def __init__(self, frequent, total: int, distinct_words: int, group_sums: dict[int, int], ends: int):
        hashes = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
        counts = np.array([r["n"] for r in frequent], np.int64)
        groups = np.array([r["tail"] for r in frequent], np.int64)
        own = np.arange(len(hashes)) < WORD_CLASSES  # most frequent first
        n_own = int(own.sum())
        self.total, self.vocabulary, self.ends = total, distinct_words, ends
        # Classes: the end, the frequent words, the groups; one more as context: nothing before.
        self.groups_at = 1 + n_own
        self.classes = self.groups_at + (1 << GROUP_BITS)
        class_of = np.where(own, 1 + np.arange(len(hashes)), -1)
        weights = np.zeros(1 << GROUP_BITS, np.int64)
        for group, n in group_sums.items():
            weights[group] = n
        np.subtract.at(weights, groups[own], counts[own] + 1)
        self.log_group = np.log10(weights + 1.0)  # and one for any unknown word
        by_class = np.concatenate([[ends], counts[own], weights]) + 1.0
        self.noise = by_class / by_class.sum()
        order = np.argsort(hashes)
        self.hashes, self.counts, self.class_of = hashes[order], counts[order], class_of[order]
        rng = np.random.default_rng(1)
        self.shapes = [(self.classes, FACTORS), (self.classes + 1, FACTORS), (2, FACTORS), (self.classes,)]
        self.parameters = [
            rng.normal(0, 0.1, self.shapes[0]).astype(np.float32),
            rng.normal(0, 0.1, self.shapes[1]).astype(np.float32),
            np.ones(self.shapes[2], np.float32),
            np.log(self.noise).astype(np.float32),
        ]

    def look_up(self, hashes, groups):
        """Each token's class, its count, and whether the count is known here."""
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        found = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        if not len(self.hashes):
            return np.where(hashes == END, 0, self.groups_at + groups), np.where(hashes == END, self.ends, 0), hashes == END
        classes = np.where(found, self.class_of[place], -1)
        classes = np.where(classes < 0, self.groups_at + groups, classes)
        end = hashes == END
        classes[end] = 0
        counts = np.where(found, self.counts[place], 0)
        counts[end] = self.ends
        return classes, counts, found | end

    def contexts(self, row, classes):
        """The classes one and two tokens before, in the same text."""
        nothing = self.classes
        one = np.concatenate([[nothing], classes[:-1]])
        two = np.concatenate([[nothing, nothing], classes[:-2]])[: len(classes)]
        same = np.concatenate([[False], row[1:] == row[:-1]])
        one[~same] = nothing
        two[~same] = nothing
        after = np.concatenate([[False], ~same[:-1]])
        two[after] = nothing
        return one, two

    def train(self, batches, rng) -> int:
        """Noise-contrastive estimation over all slices; changes the parameters, gives the tokens seen."""
        targets, before, place, bias = self.parameters
        squares = [np.full(s, 1.0, np.float32) for s in self.shapes]
        chance = np.log(NOISE * self.noise).astype(np.float32)
        bounds = np.cumsum(self.noise)
        seen = 0

        def step(number, at, rows):
            """AdaGrad on the rows ``at``, repeated ones summed."""
            order = np.argsort(at, kind="stable")
            ordered = at[order]
            head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            total = np.add.reduceat(rows[order], head, axis=0)
            at = ordered[head]
            squares[number][at] += total * total
            self.parameters[number][at] -= RATE * total / np.sqrt(squares[number][at])

        for row, classes in batches:
            one, two = self.contexts(row, classes)
            seen += len(classes)
            shuffled = rng.permutation(len(classes))
            for begin in range(0, len(shuffled), BATCH):
                some = shuffled[begin : begin + BATCH]
                w, p, q = classes[some], one[some], two[some]
                context = before[p] * place[0] + before[q] * place[1]
                noise = np.minimum(np.searchsorted(bounds, rng.random(NOISE)), self.classes - 1)
                good = (context * targets[w]).sum(axis=1) + bias[w] - chance[w]
                bad = context @ targets[noise].T + (bias[noise] - chance[noise])
                g_good = -1 / (1 + np.exp(np.minimum(good, 60)))
                g_bad = 1 / (1 + np.exp(-np.maximum(bad, -60)))
                back = g_good[:, None] * targets[w] + g_bad @ targets[noise]
                g_noise = g_bad.T @ context
                at = np.concatenate([w, noise])
                g_place = np.stack([(back * before[p]).sum(axis=0), (back * before[q]).sum(axis=0)])
                step(1, np.concatenate([p, q]), np.concatenate([back * place[0], back * place[1]]))
                step(0, at, np.concatenate([g_good[:, None] * context, g_noise]))
                step(3, at, np.concatenate([g_good, g_bad.sum(axis=0)]))
                step(2, np.arange(2), g_place)
        return seen

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters])

    def load(self, flat: np.ndarray):
        at = 0
        for i, shape in enumerate(self.shapes):
            size = int(np.prod(shape))
            self.parameters[i] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size

    def normalise(self):
        """Scores of all pairs of a context and a target, and the normaliser of all pairs of contexts."""
        targets, before, place, bias = (p.astype(np.float64) for p in self.parameters)
        near = (before * place[0]) @ targets.T
        far = (before * place[1]) @ targets.T + bias
        top_near, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        sums = np.exp(near - top_near) @ np.exp(far - top_far).T
        self.log_sums = np.log(sums) + top_near + top_far.T
        self.near, self.far = near, far

    def log_probabilities(self, classes, one, two) -> np.ndarray:
        """Natural logarithms of the classes' probabilities after their contexts."""
        return self.near[one, classes] + self.far[two, classes] - self.log_sums[one, two]


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, tail, n)``: hash, group and count of every token but the end; written once."""
    path = scratch(docs.sparkSession, "words")
    docs.select("text").mapInArrow(_counted, "word bigint, tail int, n bigint").groupBy("word").agg(
        F.max("tail").alias("tail"), F.sum("n").alias("n")
    ).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _most_frequent(names: DataFrame, most: int) -> list[dict]:
    """The most frequent words, at most ``most``, by count and then word.

    A histogram of the counts' logarithms tells from which count on so many words are had, so no task
    hands over more than what is kept.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = names.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # about 16 * 63 at most
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return []
    found = names.where(level >= least).toPandas().to_dict("records")
    return sorted(found, key=lambda r: (-r["n"], r["word"]))


def fit(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> Model:
    """The model of all ``docs``; ``counts`` are their words'."""
    spark = docs.sparkSession
    end = F.col("word") == int(END)
    total, vocabulary, ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0))
    ).first()
    names = counts.where(~end)
    most = _most_frequent(names, frequent)
    sums = {r["tail"]: r["n"] for r in names.groupBy("tail").agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    model = Model(most, total, vocabulary, sums, ends)
    for number in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches):
            own = sent.value
            own = Model.__new__(Model)
            own.__dict__.update(sent.value.__dict__)
            own.parameters = [p.copy() for p in sent.value.parameters]

            def ready():
                for batch in batches:
                    for part in slices(batch, "text"):
                        row, hashes, groups = tokens(*text_column(part.column("text")))
                        yield row, own.look_up(hashes, groups)[0]

            seen = own.train(ready(), np.random.default_rng([number, TaskContext.get().partitionId()]))
            if seen:
                flat = own.flat()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))],
                    ["place", "value", "seen"],
                )

        means = (
            docs.select("text")
            .mapInArrow(learn, "place int, value double, seen bigint")
            .groupBy("place")
            .agg((F.sum("value") / F.sum("seen")).alias("value"))
            .toPandas()  # as many numbers as the model has
        )
        flat = np.zeros(len(means))
        flat[means["place"].to_numpy()] = means["value"].to_numpy()
        model.load(flat)
    model.normalise()
    return model


def scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Null text is empty, which is the end alone. ``base_score`` and ``score`` are sums of decimal
    logarithms. Rows may repeat a doc_id or have none. Other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    base = float(np.log10(model.total + model.vocabulary + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = sent.value
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                row, hashes, groups = tokens(*text_column(part.column("text")))
                classes, counted, known = own.look_up(hashes, groups)
                one, two = own.contexts(row, classes)
                log = own.log_probabilities(classes, one, two) / np.log(10)
                grouped = classes >= own.groups_at
                log[grouped] -= own.log_group[classes[grouped] - own.groups_at]
                own_log = np.where(known, np.log10(counted + 1.0), 0)
                # Words whose counts are in the table only, once per text.
                rare = np.flatnonzero(~known)
                order = np.lexsort((hashes[rare], row[rare]))
                r, h = row[rare][order], hashes[rare][order]
                head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, int)
                lists = np.searchsorted(r[head], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at + np.arange(n)),
                        part.column("doc_id"),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row, known & (counted > 0), n).astype(np.int64)),
                        pa.array(np.bincount(row, own_log, n)),
                        pa.array(np.bincount(row, log + np.where(grouped, own_log, 0), n)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(h[head].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(np.diff(np.append(head, len(r))).astype(np.int32))),
                    ],
                    ["row_no", "doc_id", "n_tokens", "n_known", "log_counts", "log_model", "rare", "times"],
                )
                at += n

    path = scratch(spark, "scores")
    docs.select("doc_id", "text").mapInArrow(
        run,
        f"row_no bigint, doc_id {kind}, n_tokens bigint, n_known bigint, log_counts double, log_model double, "
        "rare array<bigint>, times array<int>",
    ).write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.select("row_no", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row_no", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    found = (
        rare.join(counts.select("word", "n"), "word")
        .groupBy("row_no")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(found, "row_no", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + more - F.col("n_tokens") * base).alias("base_score"),
        (F.col("log_model") + more).alias("score"),
    )


@query("op2_lm_scoring")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    training = docs.where(~held_out("doc_id", 7, 2))
    counts = count_words(training)
    return scores(docs, fit(training, counts), counts).select(
        "doc_id",
        held_out("doc_id", 7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
