"""Whitening of vectors by a covariance that polarisation recovers from exact variances.

A component becomes a whole number, so every sum is exact. After one pass for the sums, the values are
centred at their nearest whole mean, and squares of every dimension and of every sum of two dimensions
are added up as whole numbers. With the exact remainder of the means these are the variances of the
dimensions and of their pairwise sums, and half the difference var(a + b) - var(a) - var(b) is the
covariance of a and b. The matrix is put together on the driver from d * (d + 1) / 2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from listwright.llm.registry import query, table
from listwright.sources.storage import cut

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
# Whole numbers beyond this are refused; sums of squares of fewer fit a decimal of 38 digits.
_LARGEST = 1 << 40
# A component with less than this share of all variance has no direction of its own to whiten.
_FLAT = 1e-13
_ROWS = 4096
_EXACT = 1 << 53


def whole_numbers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and ``floor(SCALE * c)`` of the vectors that hold only finite numbers."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    kept = column.drop_null() if column.null_count else column
    flat = kept.flatten()
    flat = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, np.float64)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(values).all(axis=1)
        values = np.floor(SCALE * values[good])
        if values.size and np.abs(values).max() >= _LARGEST:
            raise ValueError(f"a vector holds a number of {_LARGEST // SCALE} or more")
        out[size] = rows[good], values.astype(np.int64)
    return out


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each usable vector as its length and the bytes of its whole numbers, narrow where they fit."""
    for batch in batches:
        for size, (_, values) in whole_numbers(batch.column(0)).items():
            narrow = (np.abs(values) < 1 << 31).all(axis=1)
            for some, kind in ((values[narrow], "<i4"), (values[~narrow], "<i8")):
                bodies = [row.tobytes() for row in some.astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], ["size", "body"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Length and whole numbers, some rows of one length at a time."""
    for whole in batches:
        for begin in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(begin, _ROWS)
            sizes = np.asarray(batch.column("size"), np.int64)
            width = np.asarray(pc.binary_length(batch.column("body")), np.int64) // np.maximum(sizes, 1)
            for size in np.unique(sizes).tolist():
                for bytes_ in (4, 8):
                    at = np.flatnonzero((sizes == size) & (width == bytes_))
                    if len(at):
                        raw = b"".join(batch.column("body").take(pa.array(at)).to_pylist())
                        yield size, np.frombuffer(raw, f"<i{bytes_}").reshape(-1, size).astype(np.int64)


def _partial(sums: dict[tuple[int, int], list[int]]) -> Iterator[pa.RecordBatch]:
    for (size, k), numbers in sums.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([size] * len(numbers), pa.int32()),
                pa.array([k] * len(numbers), pa.int32()),
                pa.array(range(len(numbers)), pa.int32()),
                pa.array([Decimal(v) for v in numbers], pa.decimal128(38, 0)),
            ],
            ["size", "first", "place", "total"],
        )


_TOTALS = "size int, first int, place int, total decimal(38,0)"


def _totalled(partial: DataFrame) -> dict[int, dict[int, list[int]]]:
    """By length and first index the added up numbers: one for each dimension or pair, whatever the rows."""
    rows = partial.groupBy("size", "first", "place").agg(F.sum("total").alias("total")).collect()
    out: dict[int, dict[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        out.setdefault(r["size"], {}).setdefault(r["first"], []).append(int(r["total"]))
    return out


def _sums(batches):
    """Per length the number of vectors, and the sum of every dimension."""
    totals: dict[tuple[int, int], list[int]] = {}
    for size, values in _blocks(batches):
        found = [len(values), *values.sum(axis=0).tolist()]
        old = totals.setdefault((size, 0), [0] * len(found))
        totals[size, 0] = [a + b for a, b in zip(old, found)]
    yield from _partial(totals)


def squares(values: np.ndarray) -> list[list[int]]:
    """For each dimension the sum of its squares, then those of its sums with all later dimensions."""
    largest = int(np.abs(values).max(initial=0))
    exact = 4 * largest * largest * len(values) < _EXACT  # whole numbers stay exact as doubles
    columns = np.ascontiguousarray(values.T.astype(np.float64 if exact else object))
    out = []
    for i in range(len(columns)):
        both = columns[i + 1 :] + columns[i]
        if exact:
            rest = np.einsum("dn,dn->d", both, both)
            out.append([int(v) for v in (float(columns[i] @ columns[i]), *rest.tolist())])
        else:
            out.append([int(columns[i] @ columns[i]), *[int(b @ b) for b in both]])
    return out


def _squares(means: dict[int, np.ndarray]):
    def run(batches):
        totals: dict[tuple[int, int], list[int]] = {}
        for size, values in _blocks(batches):
            for i, found in enumerate(squares(values - means[size])):
                old = totals.setdefault((size, i), [0] * len(found))
                totals[size, i] = [a + b for a, b in zip(old, found)]
        yield from _partial(totals)

    return run


class Whitener:
    """What whitens the vectors of one length."""

    def __init__(self, n: int, sums: list[int], totals: dict[int, list[int]], components: int):
        size = len(sums)
        self.n = n
        self.mean = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = [s - n * m for s, m in zip(sums, self.mean.tolist())]
        # n^2 times the variance of each dimension, then of the sums of two, in whole numbers.
        own = [n * totals[i][0] - self.rest[i] ** 2 for i in range(size)]
        cov = np.zeros((size, size))
        for i in range(size):
            cov[i, i] = own[i] / (n * n)
            for k, total in enumerate(totals[i][1:], i + 1):
                both = n * total - (self.rest[i] + self.rest[k]) ** 2
                cov[i, k] = cov[k, i] = (both - own[i] - own[k]) / (2 * n * n)
        self.covariance = cov
        values, vectors = np.linalg.eigh(cov)
        trace = sum(own) / (n * n)
        live = [k for k in range(size - 1, -1, -1) if values[k] > _FLAT * trace][:components]
        vectors = vectors[:, live]
        # One sign for all rows: a component's largest entry is positive.
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(live))] < 0, -1.0, 1.0)
        self.explained = values[live] / trace if trace else np.zeros(0)
        self.project = vectors / np.sqrt(values[live])
        self.fraction = np.array([r / n for r in self.rest])
        self.error = 0.0

    def whiten(self, values: np.ndarray) -> np.ndarray:
        return (values - self.mean - self.fraction) @ self.project

    def deviation(self, values: np.ndarray) -> list[int | None]:
        """Sum over dimensions of the square of n * x - S; null where it does not fit a long."""
        away = values - self.mean
        rest = np.array(self.rest, object)
        largest = self.n * int(np.abs(away).max(initial=0)) + max(map(abs, self.rest), default=0)
        if largest * largest * max(1, values.shape[1]) < 1 << 62:
            away = self.n * away - rest.astype(np.int64)
            return np.einsum("nd,nd->n", away, away).tolist()
        found = [int(row @ row) for row in self.n * away.astype(object) - rest]
        return [v if v < 1 << 63 else None for v in found]


def _moments(made: dict[int, Whitener]):
    """Sums and products of the whitened components, per length."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for size, values in _blocks(batches):
            white = np.hstack([np.ones((len(values), 1)), made[size].whiten(values)])
            totals[size] = totals.get(size, 0) + white.T @ white
        for size, found in totals.items():
            flat = found.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                ["size", "place", "total"],
            )

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for every length of vectors, fitted on each distinct vector of whole numbers once.

    Repeated vectors fold before the shuffle. What reaches the driver has one row for each dimension
    or pair of dimensions, whatever the number of vectors. ``error`` is measured on the fitted vectors.
    """
    whole = vectors.select("embedding").mapInArrow(_bodies, "size int, body binary")
    distinct = cut(whole.distinct())
    sums = {size: found[0] for size, found in _totalled(distinct.mapInArrow(_sums, _TOTALS)).items()}
    means = {size: np.array([(2 * s + n) // (2 * n) for s in rest], np.int64) for size, (n, *rest) in sums.items()}
    if not sums:
        return {}
    totals = _totalled(distinct.mapInArrow(_squares(means), _TOTALS))
    made = {size: Whitener(n, rest, totals[size], components) for size, (n, *rest) in sums.items()}
    moments = distinct.mapInArrow(_moments(made), "size int, place int, total double")
    rows = moments.groupBy("size", "place").agg(F.sum("total").alias("total")).collect()
    for size, one in made.items():
        flat = [r["total"] for r in sorted(rows, key=lambda r: r["place"]) if r["size"] == size]
        side = one.project.shape[1] + 1
        products = np.array(flat).reshape(side, side) / one.n
        covariance = products[1:, 1:] - np.outer(products[0, 1:], products[0, 1:])
        one.error = float(np.abs(covariance - np.eye(side - 1)).max(initial=0.0))
    return made


def whitened(vectors: DataFrame, made: dict[int, Whitener]) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for every usable
    vector and component, components numbered from 1 by falling variance.

    Vectors that are null or empty, or hold null or non-finite numbers, have no rows. Each length is
    whitened on its own. A component without variance is left out, so a single vector or copies of one
    have no rows. Repeated rows and ids stay as often as they are. Other columns are ignored.
    """
    schema = StructType(
        [
            vectors.schema["vec_id"],
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(begin, _ROWS)
                for size, (rows, values) in whole_numbers(batch.column(1)).items():
                    if not len(rows):
                        continue
                    one = made[size]
                    many = one.project.shape[1]
                    at = pa.array(np.repeat(rows, many))
                    deviation = pa.array(one.deviation(values), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), many)))
                    n = len(rows) * many
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))),
                            pa.array(np.full(n, one.n)),
                            deviation,
                            pa.array(one.whiten(values).ravel()),
                            pa.array(np.tile(one.explained, len(rows))),
                            pa.array(np.full(n, one.error)),
                        ],
                        schema.names,
                    )

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


@query("op13_embedding_whitening")
def op13(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return whitened(vectors, fit(vectors))
