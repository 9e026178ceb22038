"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of length one are projected on random lines. A table cuts ``lines`` of these projections into
cells, with random offsets, and vectors that share a cell in one of the tables meet there; the number of
lines and tables follows from the number of vectors, so that cells stay small and a pair at the threshold
meets with probability ``recall``. Where vectors meet, further projections are sorted, every vector's
window around its own value is found in each by binary search, and the windows that a pair shares are
counted. Pairs that reach the count which pairs at the threshold nearly always reach are verified in
double precision. A cell larger than ``block`` is cut into blocks, and each pair of blocks is one piece
of work, so no cell gathers in a task; pairs are counted where they are found and never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.components import components
from listwright.llm.registry import query, table
from listwright.llm.text import groups, least_reached
from listwright.sources.storage import cut

THRESHOLD = 0.9
RECALL = 0.97
CELL = 2.0  # width of a table's cells, in standard deviations of a projection
MEETING = 64  # unlike vectors that a cell should have
WINDOW = 0.9  # half the width of the windows whose collisions are counted
COUNTED = 16  # projections with windows
BLOCK = 4096


def _same_cell(distance: float) -> float:
    """Probability that two vectors so far apart fall in one cell of a projection."""
    x = np.linspace(-CELL, CELL, 4001)
    density = np.exp(-((x / distance) ** 2) / 2) / (distance * math.sqrt(2 * math.pi))
    return float(((1 - np.abs(x) / CELL) * density).sum() * (x[1] - x[0]))


class Tables:
    """Random lines, and how many are needed for ``n`` vectors; the same for the same arguments."""

    def __init__(self, n: int, threshold: float, recall: float = RECALL):
        apart = math.sqrt(2 - 2 * threshold)
        near, far = _same_cell(apart), _same_cell(math.sqrt(2))
        self.lines = max(1, math.ceil(math.log(max(2.0, n / MEETING)) / -math.log(far)))
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - near**self.lines))
        # Windows that a pair at the threshold shares, but for one pair in 200.
        hit = math.erf(WINDOW / apart / math.sqrt(2))
        chance = [math.comb(COUNTED, k) * hit**k * (1 - hit) ** (COUNTED - k) for k in range(COUNTED + 1)]
        self.least = max(k for k in range(COUNTED + 1) if sum(chance[k:]) >= 0.995)
        self.threshold = threshold
        self.drawn: dict[int, tuple[np.ndarray, ...]] = {}

    def _draw(self, size: int):
        if size not in self.drawn:
            rng = np.random.default_rng([17, size])
            many = self.lines * self.tables
            self.drawn[size] = rng.normal(size=(size, many)), rng.random(many) * CELL, rng.normal(size=(size, COUNTED))
        return self.drawn[size]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One number per vector and table."""
        directions, offsets, _ = self._draw(unit.shape[1])
        steps = np.floor((unit @ directions + offsets) / CELL).astype(np.int64).astype(np.uint64)
        steps = steps.reshape(len(unit), self.tables, self.lines)
        out = np.zeros(steps.shape[:2], np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out += np.uint64(unit.shape[1])
        for k in range(self.lines):
            out = (out ^ steps[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)

    def links(self, a: np.ndarray, b: np.ndarray | None, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (of ``a`` with ``b``, or within ``a``) that first meet in table ``number``."""
        other = a if b is None else b
        lines = self._draw(a.shape[1])[2]
        mine, theirs = a @ lines, other @ lines
        order = np.argsort(theirs, axis=0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        strip = max(1, (1 << 20) // len(other))
        for begin in range(0, len(a), strip):
            q = mine[begin : begin + strip]
            count = np.zeros((len(q), len(other)), np.int8)
            for k in range(COUNTED):
                values = theirs[order[:, k], k]
                step = np.zeros((len(q), len(other) + 1), np.int8)
                rows = np.arange(len(q))
                step[rows, np.searchsorted(values, q[:, k] - WINDOW, "left")] += 1
                step[rows, np.searchsorted(values, q[:, k] + WINDOW, "right")] -= 1
                count[:, order[:, k]] += np.cumsum(step, axis=1, dtype=np.int8)[:, :-1]
            i, j = np.nonzero(count >= self.least)
            i += begin
            if b is None:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 17):
                x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                good = np.einsum("nd,nd->n", a[x], other[y]) >= self.threshold
                found.append((x[good], y[good]))
        i, j = (np.concatenate(side) for side in zip(*found)) if found else (np.zeros(0, int),) * 2
        if number and len(i):
            before = self.cells(a)[:, :number]
            before_other = before if b is None else self.cells(b)[:, :number]
            new = np.ones(len(i), bool)
            for t in range(number):
                new &= before[i, t] != before_other[j, t]
            i, j = i[new], j[new]
        return i, j


def _unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and vectors of length one, of the rows that have a direction."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    kept = column.drop_null() if column.null_count else column
    flat = kept.flatten()
    flat = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, np.float64)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat[begin[rows][:, None] + np.arange(size)]
        with np.errstate(all="ignore"):
            values = values / np.abs(values).max(axis=1, keepdims=True)
            values = values / np.sqrt((values * values).sum(axis=1, keepdims=True))
        good = np.isfinite(values).all(axis=1)
        out[size] = rows[good], values[good]
    return out


def _cells(tables: Tables):
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                for rows, unit in _unit_rows(part.column("embedding")).values():
                    if not len(rows):
                        continue
                    cells = tables.cells(unit)
                    take = pa.array(np.repeat(rows, tables.tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells.ravel()),
                            pa.array(np.tile(np.arange(tables.tables, dtype=np.int32), len(rows))),
                            part.column("vec_id").take(take),
                            part.column("embedding").take(take),
                        ],
                        ["cell", "number", "vec_id", "embedding"],
                    )

    return run


def _linked(tables: Tables):
    def run(batches):
        for part in groups(batches, ["cell", "left", "right"]):
            if part.num_rows < 2:
                continue
            for rows, unit in _unit_rows(part.column("embedding")).values():
                ids = np.asarray(part.column("vec_id"), np.int64)[rows]
                number = part.column("number")[0].as_py()
                own = np.asarray(part.column("own"), np.int64)[rows]
                left, right = part.column("left")[0].as_py(), part.column("right")[0].as_py()
                a = np.flatnonzero(own == left)
                if left == right:
                    i, j = tables.links(unit, None, number)
                else:
                    b = np.flatnonzero(own == right)
                    if not len(a) or not len(b):
                        continue
                    i, j = tables.links(unit[a], unit[b], number)
                    i, j = a[i], b[j]
                differ = ids[i] != ids[j]
                i, j = i[differ], j[differ]
                if not len(i):
                    continue
                # One edge per vector stands for all links of the group: to the least it reaches.
                label = least_reached(ids, i, j)
                n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(n[some]), pa.array(label[some])], ["vec_id", "n", "least"]
                )

    return run


def vector_groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vec_id.

    Vectors that are null, empty or zero, or hold null or non-finite components, and vectors of unlike
    length, do not link. Rows that repeat a vec_id are one vector, the least of theirs that is not null.
    A null vec_id links with nothing; its component_id is null, it is kept, and each such row is returned.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    vectors = vectors.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    known = cut(vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    tables = Tables(known.count(), threshold, recall)
    kind = vectors.schema["embedding"].dataType.simpleString()
    met = known.mapInArrow(_cells(tables), f"cell bigint, number int, vec_id bigint, embedding {kind}")
    sizes = met.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    pieces = (
        met.join(sizes, "cell")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        .withColumn("left", F.least("own", "other"))
        .withColumn("right", F.greatest("own", "other"))
        .drop("size", "other")
    )
    found = cut(
        pieces.repartition("cell", "left", "right")
        .sortWithinPartitions("cell", "left", "right")
        .mapInArrow(_linked(tables), "vec_id bigint, n bigint, least bigint")
    )
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    named = counts.join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumnRenamed("vec_id", "_id")
    component = F.coalesce("component", "vec_id")
    ids = known.select("vec_id").unionByName(vectors.where("vec_id IS NULL").select("vec_id"))
    return ids.join(named, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


@query("op5_embedding_near_dedup")
def op5(spark, folder):
    return vector_groups(table(spark, folder, "embeddings"))
