"""Best-fit packing by patterns fitted with non-negative least squares.

Whatever the corpus, what has to be packed is a histogram of at most ``capacity`` piece lengths; that
is all the driver sees. Patterns of two or three lengths that fill a sequence exactly are enumerated,
their repeat counts fitted to the histogram by non-negative least squares, rounded down to what is
there, and the residual is packed best fit decreasing, a whole group of equal sequences at a time.
The pieces never leave their tasks: numbered within their length, they look up their place in the
pattern table, whose size does not grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.registry import query, table
from listwright.llm.text import slices, text_column
from listwright.llm.tokens import PATH, encoder
from listwright.sources.storage import scratch

CAPACITY = 1024
END_ID = 2
ROUNDS = 200


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of lengths that sum to ``capacity``; rows padded with 0 in front."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True  # a pair is a triple with an empty first
    a, b = np.meshgrid(np.append(0, lengths), lengths, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    c = capacity - a - b
    good = (c >= b) & there[np.clip(c, 0, capacity)]
    return np.stack([a[good], b[good], c[good]], axis=1)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x with patterns' use of lengths close to the histogram, by multiplicative steps."""
    def used(x):
        got = np.bincount(patterns.ravel(), np.repeat(x, 3), len(histogram))
        got[0] = 0
        return got

    target = histogram.astype(float)
    target[0] = 0
    up = target[patterns].sum(axis=1)
    x = np.full(len(patterns), target.sum() / max(1, 3 * len(patterns)) + 1e-9)
    for _ in range(rounds):
        x *= up / np.maximum(used(x)[patterns].sum(axis=1), 1e-12)
    return x


def pattern_counts(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)``: every counted piece has one place. ``histogram[l]`` pieces have length l.

    Rounding is tried three ways and the one with the fewest sequences taken: the fitted counts, and
    with them whatever exact patterns still have pieces, or every count rounded down to none, which
    suits histograms with hardly a piece per length.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    whole = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    x = fit_counts(patterns, left)
    order = np.argsort(-x, kind="stable")
    patterns, x = patterns[order], np.floor(x[order]).astype(np.int64)
    tried = []
    for passes in ([x, np.full(len(x), left.sum())], [x], []):
        rest, out = left.copy(), list(whole)
        for wanted in passes:
            out += _taken(patterns, wanted, rest)
        tried.append(out + _best_fit(rest, capacity))
    return min(tried, key=lambda groups: sum(n for _, n in groups))


def _taken(patterns: np.ndarray, wanted: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as wanted or as ``left`` allows; takes their pieces out of ``left``."""
    out = []
    for pattern, most in zip(patterns.tolist(), wanted.tolist()):
        if not most:
            continue
        lengths = [v for v in pattern if v]
        n = min(most, min(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((tuple(lengths[::-1]), n))
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over groups of equal sequences, by the space they have left."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n, space = int(left[length]), length
        while n:
            while space < capacity and not room[space]:
                space += 1
            pattern, repeats = room[space].pop() if room[space] else ((), n)
            fit = space // length
            full = min(repeats, n // fit)
            if full:
                room[space - fit * length].append((pattern + (length,) * fit, full))
                n -= full * fit
                repeats -= full
            if repeats and 0 < n < fit:
                room[space - n * length].append((pattern + (length,) * n, 1))
                n, repeats = 0, repeats - 1
            if repeats and pattern:
                room[space].append((pattern, repeats))
    return [group for groups in room for group in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """By (length, first rank): the first sequence, how many of the length each has, their offset."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for lengths, repeats in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            times = lengths.count(length)
            rows.append((length, taken[length], base, times, offset))
            taken[length] += times * repeats
            offset += times * length
        base += repeats
    made = np.array(sorted(rows) or np.zeros((0, 5)), np.int64)
    return dict(zip(("length", "rank", "base", "times", "offset"), made.T))


def _pieces(capacity: int, tokenizer: str, with_ids: bool):
    def run(batches):
        encode = encoder(tokenizer).ids
        part_no = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = encode(*text_column(part.column("text")))
                size = np.diff(offsets) + 1
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lead = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, lead[row], capacity)
                ids = np.empty(int(size.sum()), "<u4")
                begin = offsets[:-1] + np.arange(len(size))
                ids[begin + size - 1] = END_ID
                stay = np.ones(len(ids), bool)
                stay[begin + size - 1] = False
                ids[stay] = flat
                at = begin[row] + start
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                # How many pieces of the length this task has had before.
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(length), np.int64)
                of = np.bincount(length, minlength=capacity + 1)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(of) - of, of)
                nth += seen[length]
                seen += of
                columns = [
                    part.column("doc_id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(np.full(len(row), part_no), pa.int64()),
                    pa.array(nth, pa.int64()),
                ]
                if with_ids:
                    ends = np.append(at, len(ids)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32))))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def _placed(table_of: dict[str, np.ndarray]):
    def run(batches):
        keys = table_of["length"] << 48 | table_of["rank"]
        for batch in batches:
            length = np.asarray(batch.column("length"), np.int64)
            rank = np.asarray(batch.column("rank"), np.int64)
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            within = rank - table_of["rank"][at]
            times = table_of["times"][at]
            sequence = table_of["base"][at] + within // times
            offset = table_of["offset"][at] + within % times * length
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = PATH, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and the end id; a longer one than ``capacity`` is cut into pieces of that
    length, of which the first may be shorter. Null or empty text is the end id alone. Rows that
    repeat a doc_id, or have none, are packed like any other. ``with_ids`` adds the piece's ids.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    more = ", ids array<int>" if with_ids else ""
    path = scratch(spark, "pieces")
    docs.select("doc_id", "text").mapInArrow(
        _pieces(capacity, tokenizer, with_ids), f"{out}, part bigint, nth bigint{more}"
    ).write.parquet(path)
    pieces = spark.read.parquet(path)

    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    table_of = slots(pattern_counts(histogram, capacity), capacity)

    # Ranks within a length: those of a task's pieces follow those of the tasks before it.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*columns, "rank").mapInArrow(
        _placed(table_of), f"{out}{more}, sequence_id bigint, offset bigint"
    )


@query("op4_best_fit_packing")
def op4(spark, folder):
    return pack(table(spark, folder, "documents"))
