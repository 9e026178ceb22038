"""Words and hashes of Arrow text columns, a whole slice of a batch at a time.

A text column is one byte buffer with row offsets; words are found, and hashed eight bytes at a
time, with numpy over that buffer. Null text counts as empty. White space is ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; numpy's temporaries take about 30 times as much.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text together; a longer text comes alone."""
    if not batch.num_rows:
        return
    sizes = np.diff(text_column(batch.column(column))[1])
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary column."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and one past) its first word's number."""
    n = len(data)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _GOLD + np.uint64(seed))
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = sizes[live] - at
        out[live] = mix((out[live] ^ (eight[starts[live] + at] & _MASKS[np.minimum(left, 8)])) + _GOLD)
        live = live[left > 8]
        at += 8
    return out


def run_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive items; the last ``size - 1`` items start none."""
    n = max(0, len(items) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out * np.uint64(0xD6E8FEB86659FD93) + items[j : j + n]) ^ (out >> np.uint64(29))
    return mix(out)


def distinct(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct items, the place of one of each, and each item's number among them."""
    order = np.argsort(items)
    ordered = items[order]
    new = np.ones(len(items), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(items), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return steps + np.arange(total)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and row offsets."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())],
    )


class Memo:
    """Values of text chunks by hash, kept over slices: a run of numbers and one figure for each.

    Holds no more than ``limit`` chunks beyond those of one slice; then it starts anew.
    """

    def __init__(self, kind, limit: int):
        self.kind, self.limit = kind, limit
        self._clear()

    def _clear(self):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.figures, self.flat = np.zeros(0), np.zeros(0, self.kind)

    def places(self, keys: np.ndarray, make) -> np.ndarray:
        """Where the sorted distinct ``keys`` are. ``make(new)`` gives the numbers of the chunks that
        the mask ``new`` selects, one chunk after the other, their sizes, and their figures."""
        if len(self.keys) > self.limit:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            flat, sizes, figures = make(new)
            everything = np.concatenate([self.keys, keys[new]])
            order = np.argsort(everything)
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.keys = everything[order]
            self.starts = np.concatenate([self.starts, starts])[order]
            self.sizes = np.concatenate([self.sizes, sizes])[order]
            self.figures = np.concatenate([self.figures, figures])[order]
            self.flat = np.concatenate([self.flat, flat])
            place = np.searchsorted(self.keys, keys)
        return place


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal numbers in ``columns``, over the borders of batches; a batch each."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c), np.int64) for c in columns], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if kept and tuple(keys[a]) != last:
                yield _one(kept)
                kept = []
            last = tuple(keys[a])
            kept.append(batch.slice(a, b - a))
    if kept:
        yield _one(kept)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def least_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each id the least id that links between the places ``i`` and ``j`` lead to."""
    label = ids.copy()
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == label).all():
            return label
        label = new
