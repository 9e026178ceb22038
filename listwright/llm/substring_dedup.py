"""Duplicate passages by an index of all windows of earlier documents.

No document is factored: the dealt relative Lempel-Ziv parse was exchanged for the look-up of every
window (see the README). The reference of a document is all documents of smaller id, indexed
in blocks. Every window of 13 words has one seed, the run of 5 words in it with the least hash; a
block is what shares a seed, and holds each of its windows with the first document that has it. A
window depends on its words alone, so equal windows always meet in one block, and a word is a
duplicate exactly if one of its windows occurs earlier.

One row goes to a block per seed that a document has (about every fifth word), with hashes of the
up to nine windows that share it: 64 bits of the seed and 48 of each window tell windows apart.
Rows of a seed come sorted by document, so a block of any size is one pass with its first
occurrences in memory. Copies within one slice of a task are found there and do not travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from listwright.llm.registry import query, table
from listwright.llm.text import SLICE_BYTES, binary_column, ragged, run_hashes, slices, span_hashes, text_column, words

WINDOW = 13
SEED = 5
_HASH_BYTES = 6
_ROWS = 60_000

INDEX_SCHEMA = "seed bigint, doc bigint, place bigint, body binary"
FOUND_SCHEMA = "doc bigint, mark int, span bigint"


def _seed_rows(docs: np.ndarray, marks: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
    """Index rows of some documents: (seed hash, row's document, first window, window hashes)."""
    starts, ends, first = words(data, offsets)
    if len(starts) < window:
        return None
    hashes = span_hashes(data, starts, ends)
    seeds = run_hashes(hashes, seed)
    whole = run_hashes(hashes, window)
    span = window - seed + 1
    n = len(whole)
    least, at = seeds[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = seeds[j : j + n] < least
        least[less] = seeds[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = np.flatnonzero(np.arange(n) + window <= first[row[:n] + 1])
    if not len(inside):
        return None
    row, at, least, whole = row[inside], at[inside], least[inside], whole[inside]

    # Windows whose first occurrence in this slice is an earlier document need not travel.
    order = np.lexsort((docs[row], whole))
    new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    firsts = docs[row][order][np.flatnonzero(new)]
    here = np.empty(len(whole), bool)
    here[order] = docs[row][order] > firsts[np.cumsum(new) - 1]

    run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    sizes = np.diff(np.append(run, len(at)))
    all_here = np.add.reduceat(here, run) == sizes
    place = ((marks[row[run]] & 0xFFFF) << 40) | (inside[run] - first[row[run]])
    return row[run], least[run], place, run, sizes, whole, all_here


def _index(window: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                docs = np.asarray(part.column("doc_id"), np.int64)
                marks = np.asarray(part.column("mark"), np.int64)
                made = _seed_rows(docs, marks, *text_column(part.column("text")), window, seed)
                if made is None:
                    continue
                row, key, place, start, sizes, whole, here = made
                # Found here: the mask of the found windows stands for their hashes.
                masks = ((1 << sizes) - 1).astype("<u2")
                length = np.where(here, 2, sizes * _HASH_BYTES)
                offsets = np.concatenate([[0], np.cumsum(length)])
                body = np.empty(int(offsets[-1]), np.uint8)
                body[ragged(offsets[:-1][here], length[here])] = masks[here].view(np.uint8)
                go = ~here
                bytes_of = whole.view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]
                body[ragged(offsets[:-1][go], length[go])] = bytes_of[ragged(start[go], sizes[go])].ravel()
                # Rows found here go anywhere; their place spreads them.
                to = np.where(here, place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.view(np.int64)), pa.array(docs[row]), pa.array(place), binary_column(body, offsets)],
                    ["seed", "doc", "place", "body"],
                )

    return run


def _lookup(batches):
    """Rows sorted by (seed, document) in; masks of the windows that an earlier document has out."""
    kept_seed, kept_keys, kept_docs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for whole_batch in batches:
        for begin in range(0, whole_batch.num_rows, _ROWS):
            batch = whole_batch.slice(begin, _ROWS)
            seeds = np.asarray(batch.column(0), np.int64)
            docs = np.asarray(batch.column(1), np.int64)
            place = np.asarray(batch.column(2), np.int64)
            body, offsets = text_column(batch.column(3))
            length = np.diff(offsets)
            mask = np.zeros(len(seeds), np.int64)
            done = np.flatnonzero(length == 2)
            mask[done] = body[offsets[done]].astype(np.int64) | body[offsets[done] + 1].astype(np.int64) << 8
            ask = np.flatnonzero(length > 2)
            if len(ask):
                n = length[ask] // _HASH_BYTES
                raw = np.zeros((int(n.sum()), 8), np.uint8)
                raw[:, :_HASH_BYTES] = body[ragged(offsets[ask], length[ask])].reshape(-1, _HASH_BYTES)
                keys = raw.view("<u8").ravel()
                rows = np.repeat(ask, n)
                group = np.cumsum(np.concatenate([[0], seeds[ask][1:] != seeds[ask][:-1]]))
                full = np.repeat(group, n).astype(np.uint64) << np.uint64(48) | keys
                order = np.argsort(full, kind="stable")  # stable: documents stay in order
                new = np.concatenate([[True], full[order][1:] != full[order][:-1]])
                own = docs[rows][order]
                head = np.flatnonzero(new)
                first_doc = own[head]
                first_key = full[order][head]
                if kept_seed == seeds[ask[0]]:  # the block goes on from the batch before
                    known = np.searchsorted(kept_keys, first_key)
                    known[known == len(kept_keys)] = 0
                    same = kept_keys[known] == first_key
                    first_doc = np.where(same, np.minimum(first_doc, kept_docs[known]), first_doc)
                hit = np.empty(len(full), bool)
                hit[order] = own > first_doc[np.cumsum(new) - 1]
                bit = np.arange(len(full)) - np.repeat(np.cumsum(n) - n, n)
                mask[ask] = np.add.reduceat(hit.astype(np.int64) << bit, np.cumsum(n) - n)
                last = np.uint64(group[-1]) << np.uint64(48)
                tail = first_key >= last
                keys_now, docs_now = first_key[tail] - last, first_doc[tail]
                if kept_seed == seeds[ask[-1]]:
                    keys_now = np.concatenate([kept_keys, keys_now])
                    keys_now, at = np.unique(keys_now, return_index=True)
                    docs_now = np.concatenate([kept_docs, docs_now])[at]
                kept_seed, kept_keys, kept_docs = seeds[ask[-1]], keys_now, docs_now
            some = np.flatnonzero(mask)
            span = (place[some] & ((1 << 40) - 1)) << 16 | mask[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[some]), pa.array((place[some] >> 40).astype(np.int32)), pa.array(span)],
                ["doc", "mark", "span"],
            )


def removed_words(n_words: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Which words the found windows cover."""
    first, mask = spans >> 16, spans & 0xFFFF
    steps = np.zeros(n_words + window + 16, np.int64)
    for j in range(16):
        at = first[(mask >> j) & 1 == 1] + j
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[:n_words] > 0


def _texts(keep_spaces: bool, window: int):
    """Adds to each row its words' number, the removed ones' number, and the text that is left."""

    def one(part):
        data, offsets = text_column(part.column("text"))
        starts, ends, first = words(data, offsets)
        spans = part.column("spans")
        n_words = np.diff(first)
        gone = np.zeros(len(starts), bool)
        for i in np.flatnonzero(np.asarray(spans.is_valid())):
            got = np.asarray(spans[i].values, np.int64)
            gone[first[i] : first[i + 1]] = removed_words(n_words[i], got, window)
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[first[1:]] - removed[first[:-1]]
        raw = data.tobytes()
        texts = []
        for i in range(part.num_rows):
            a, b = first[i], first[i + 1]
            if keep_spaces and not removed[i]:
                texts.append(raw[offsets[i] : offsets[i + 1]])
            elif keep_spaces:  # a removed word goes with the white space behind it
                stay = np.ones(offsets[i + 1] - offsets[i], bool)
                to = np.append(starts[a + 1 : b], offsets[i + 1])
                cuts = np.flatnonzero(gone[a:b])
                stay[ragged(starts[a:b][cuts] - offsets[i], to[cuts] - starts[a:b][cuts])] = False
                texts.append(data[offsets[i] : offsets[i + 1]][stay].tobytes())
            else:
                live = np.flatnonzero(~gone[a:b]) + a
                # One space after each kept word but the last.
                size = ends[live] - starts[live] + 1
                out = np.full(int(size.sum()), 32, np.uint8)
                out[ragged(np.cumsum(size) - size, size - 1)] = data[ragged(starts[live], size - 1)]
                texts.append(out[:-1].tobytes())
        return n_words, removed, texts

    return one


_SQUEEZED = StructField("squeezed", BinaryType())


def _squeezed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in slices(batch, "text"):
            texts = [None if t is None else pack(t) for t in part.column(at).cast(pa.binary()).to_pylist()]
            rest = [i for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in rest], pa.array(texts, pa.binary())],
                [*[part.schema.names[i] for i in rest], "squeezed"],
            )


def _open(batch):
    """Slices of the batch with ``squeezed`` opened again as ``text``, few texts at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    at = batch.schema.get_field_index("squeezed")
    for part in slices(batch, "squeezed", SLICE_BYTES // 4):
        texts = [None if t is None else unpack(t) for t in part.column(at).to_pylist()]
        yield part.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))


def found_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with ``(mark, spans)``: packed windows of the row that a smaller doc_id has.

    Texts meet their spans compressed, in ``squeezed``, which is most of what this shuffle moves.
    """
    marked = docs.withColumn("mark", F.xxhash64("text").bitwiseAND(0xFFFF).cast("int"))
    small = marked.mapInArrow(_squeezed, StructType([*[f for f in marked.schema if f.name != "text"], _SQUEEZED]))
    index = (
        marked.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "mark", "text")
        .mapInArrow(_index(window, seed), INDEX_SCHEMA)
    )
    found = (
        index.repartition("seed")
        .sortWithinPartitions("seed", "doc")
        .mapInArrow(_lookup, FOUND_SCHEMA)
        .groupBy("doc", "mark")
        .agg(F.collect_list("span").alias("spans"))
    )
    right = found.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "spans")
    on = (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    return small.join(right, on, "left").drop("_doc", "_mark")


def kept_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per input row.

    Null text has no words. A null doc_id is never a reference and loses nothing. Rows with one
    doc_id are judged apart and do not count as each other's reference. Other columns are ignored.
    """
    make = _texts(False, window)

    def run(batches):
        for batch in batches:
            for part in _open(batch):
                n, removed, texts = make(part)
                sums = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = found_spans(docs.select("doc_id", "text"), window, seed)
    return found.select("doc_id", "squeezed", "spans").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with the words of repeated passages taken out of ``text``; all rows stay.

    Texts without a repeat keep every byte. ``n_chars``, if there, is that of the new text.
    """
    make = _texts(True, window)
    columns = docs.columns
    kept = [c for c in columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))

    def run(batches):
        for batch in batches:
            for part in _open(batch):
                valid = part.column("text").is_valid()
                made = pa.array(make(part)[2], pa.binary()).cast(pa.string())
                made = pc.if_else(valid, made, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([made, part.column("row")], ["text", "row"])

    found = found_spans(packed, window, seed)
    schema = StructType([StructField("text", StringType()), packed.schema["row"]])
    out = found.select("squeezed", "spans", "row").mapInArrow(run, schema)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None
    return out.select(
        *[
            F.col("text") if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
            for c in columns
        ]
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT r, i + o AS p FROM win JOIN firsts USING (g), range(0, 13) AS t(o) WHERE m < doc_id),
word AS (SELECT r, i AS p, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op10_substring_dedup", SQL)
def op10(spark, folder):
    return kept_words(table(spark, folder, "documents"))
