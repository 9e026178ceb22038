"""Byte-level BPE encoding and decoding of whole text columns, by a file of ranks.

Pieces are cut by a scan (``boundaries``). Each distinct piece of a slice is merged once and kept for the
next slices: short pieces all together, one merge of the least-ranked, leftmost pair in each per step;
long ones by a heap. Ids are put together with numpy, along with the byte at which each begins, so any
run of ids can be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from listwright.llm.boundaries import class_table, piece_starts
from listwright.llm.registry import query, table
from listwright.llm.text import Memo, binary_column, distinct, ragged, slices, span_hashes, text_column

RANKS = "byte_bpe_50k.tiktoken"
_CACHED = 500_000
_SHORT = 32  # bytes of a piece that is merged together with others
_NONE = np.iinfo(np.int32).max


def ranks_path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


class Ranks:
    """A vocabulary as arrays: every id's bytes, and the rank of every pair that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, number in self.rank.items():
            tokens[number] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        # A pair merges if its bytes together are a token, whose number is the pair's rank.
        pairs = {
            (self.rank[t[:k]] << 32 | self.rank[t[k:]]): number
            for t, number in self.rank.items()
            for k in range(1, len(t))
            if t[:k] in self.rank and t[k:] in self.rank
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)
        self.classes = class_table()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merged[at], _NONE)

    def merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces [begin, end), one piece after the other, how many each has, and zeros."""
        size = end - begin
        raw = data.tobytes()
        known = np.array([self.rank.get(raw[a:b], -1) for a, b in zip(begin.tolist(), end.tolist())], np.int32)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.flatnonzero(known >= 0)
        parts.append((whole, np.ones(len(whole), np.int64), known[whole]))
        least = 0
        for most in (8, 16, _SHORT):
            some = np.flatnonzero((known < 0) & (size > least) & (size <= most))
            parts.append((some, *self._together(data, begin[some], size[some])))
            least = most
        for i in np.flatnonzero((known < 0) & (size > _SHORT)).tolist():
            found = self._by_heap(self.single[data[begin[i] : end[i]]].tolist())
            parts.append((np.array([i]), np.array([len(found)]), np.array(found, np.int32)))
        piece = np.concatenate([p[0] for p in parts])
        count = np.concatenate([p[1] for p in parts])
        flat = np.concatenate([p[2] for p in parts])
        order = np.argsort(piece)
        starts = np.cumsum(count) - count
        return flat[ragged(starts[order], count[order])], count[order], np.zeros(len(size))

    def _together(self, data, begin, size):
        """Each row of a matrix is a piece; every step merges one pair in each row that has one."""
        if not len(size):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        width = int(size.max())
        at = np.arange(width)
        inside = at < size[:, None]
        ids = np.where(inside, self.single[data[np.where(inside, begin[:, None] + at, 0)]], -1).astype(np.int32)
        ranks = np.full((len(size), width), _NONE, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.pair_ranks(ids[:, :-1], ids[:, 1:]), _NONE)
        count = size.copy()
        live = np.arange(len(size))
        while len(live):
            now = ranks[live]
            place = now.argmin(axis=1)
            rank = now[np.arange(len(live)), place]
            more = rank < _NONE
            live, place, rank = live[more], place[more], rank[more]
            if not len(live):
                break
            # What stands behind the pair moves up by one.
            source = np.minimum(at + (at > place[:, None]), width - 1)
            row = ids[live[:, None], source]
            row[np.arange(len(live)), place] = rank
            row[:, -1][place < width - 1] = -1
            moved = ranks[live[:, None], source]
            moved[:, -1] = _NONE
            rows = np.arange(len(live))
            for shift in (-1, 0):
                left = place + shift
                ok = (left >= 0) & (left + 1 < count[live] - 1)
                r, left = rows[ok], left[ok]
                moved[r, left] = self.pair_ranks(row[r, left], row[r, left + 1])
            last = np.minimum(count[live] - 2, width - 1)  # the last id has no right neighbour
            moved[rows, last] = _NONE
            ids[live], ranks[live] = row, moved
            count[live] -= 1
        return count, ids[at < count[:, None]]

    def _by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self._pair_dict
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(rank, ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := rank_of(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]

    def _pair_dict(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        at = int(np.searchsorted(self.pairs, key))
        return int(self.merged[at]) if at < len(self.pairs) and self.pairs[at] == key else None

    def encode(self, data: np.ndarray, offsets: np.ndarray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other, and row offsets into them."""
        n = len(offsets) - 1
        begin = piece_starts(data, offsets, self.classes)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        end = np.append(begin[1:], len(data))
        keys, at, inverse = distinct(span_hashes(data, begin, end))
        b, e = begin[at], end[at]
        place = memo.places(keys, lambda new: self.merge(data, b[new], e[new]))[inverse]
        size = memo.sizes[place]
        row = np.searchsorted(offsets, begin, "right") - 1
        per = np.bincount(row, size, n).astype(np.int64)
        return memo.flat[ragged(memo.starts[place], size)], np.concatenate([[0], np.cumsum(per)])

    def byte_starts(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The byte of its row at which each id begins."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return ends[:-1] - np.repeat(ends[offsets[:-1]], np.diff(offsets))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text bytes of all rows and their offsets."""
        size = self.sizes[ids]
        return self.bytes[ragged(self.starts[ids], size)], np.concatenate([[0], np.cumsum(size)])[offsets]


_TOKENS = [StructField("ids", ArrayType(IntegerType(), False)), StructField("starts", ArrayType(IntegerType(), False))]


def _sent(df: DataFrame, ranks: str):
    """The vocabulary for all tasks; as large as its file and one byte for every code point."""
    return df.sparkSession.sparkContext.broadcast(Ranks(ranks_path(ranks)))


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` and ``starts`` (the byte of the UTF-8 text at which each
    id begins), one row per input row.

    Null and empty texts have no ids. Strings of special tokens are ordinary text. Other columns pass
    through, but those called ``ids`` and ``starts`` are replaced. A text may be as long as the ids of
    one row can be (2^31).
    """
    made = _sent(docs, ranks)
    kept = [c for c in docs.columns if c not in ("text", "ids", "starts")]
    packed = docs.select("text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"))

    def run(batches):
        vocabulary, memo = made.value, Memo(np.int32, _CACHED)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = vocabulary.encode(*text_column(part.column("text")), memo)
                bounds = pa.array(offsets.astype(np.int32))
                starts = pa.array(vocabulary.byte_starts(flat, offsets).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(flat)), pa.ListArray.from_arrays(bounds, starts)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *lists], ["row", "ids", "starts"])

    out = packed.mapInArrow(run, StructType([packed.schema["row"], *_TOKENS]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "ids", "starts")


def _id_slices(batch: pa.RecordBatch, step: int = 500_000):
    """Runs of rows with about ``step`` ids: the rows' part, all ids, and row offsets into them."""
    ids = batch.column("ids")
    sizes = np.asarray(pc.list_value_length(ids).fill_null(0), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.asarray(ids.drop_null().flatten(), np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + step, "right")) - 1)
        yield batch.slice(begin, end - begin), flat[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``bytes``, the text of ``ids`` in UTF-8 (a cut run of ids may begin or end
    inside a character). Null ids give null; a column called ``bytes`` is replaced."""
    made = _sent(encoded, ranks)
    kept = [c for c in encoded.columns if c != "bytes"]
    packed = encoded.select("ids", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))

    def run(batches):
        for batch in batches:
            for part, flat, offsets in _id_slices(batch):
                found = binary_column(*made.value.decode(flat, offsets))
                found = pc.if_else(part.column("ids").is_valid(), found, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("row"), found], ["row", "bytes"])

    out = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("bytes", BinaryType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "bytes")


def _digests(batches):
    for batch in batches:
        for part, flat, offsets in _id_slices(batch):
            raw = flat.astype("<u4").tobytes()
            cuts = (4 * offsets).tolist()
            sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            rest = [part.column(c) for c in ("doc_id", "bytes")]
            yield pa.RecordBatch.from_arrays(
                [rest[0], pa.array(np.diff(offsets)), pa.array(sums), rest[1]], ["doc_id", "n_tokens", "ids_sha256", "bytes"]
            )


@query("op12_byte_bpe")
def op12(spark, folder):
    """Every document's number of ids, their digest, and the digest of the bytes that they decode to."""
    encoded = encode(table(spark, folder, "documents").select("doc_id", "text")).drop("starts")
    both = decode(encoded).mapInArrow(_digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, bytes binary")
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
