"""Unigram segmentation into the pieces of a SentencePiece model, and back.

The best-scoring split of a text is found by Viterbi over a double-array trie of the pieces. A space
is written as the marker that pieces carry in front, and one marker goes before the text. As no piece
has a marker behind another character, a text falls into chunks (spaces and what follows them) whose
best splits are independent, so each distinct chunk is split once, and all new chunks of a slice are
split together: one step of the Viterbi is a numpy operation over all of them.

A character that no piece covers costs the least score less ten and becomes its UTF-8 bytes' pieces.
So does a marker character that the text itself holds, which makes decoding exact.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from listwright.llm.registry import query, table
from listwright.llm.text import Memo, distinct, ragged, slices, span_hashes, text_column

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
_CACHED = 200_000
# Bytes of a UTF-8 character by its first byte; 1 for bytes that cannot be first.
_CHAR = np.ones(256, np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(base, check, value)``: state s goes by byte c to base[s] + c if check there is s."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys.items():
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                values.append(-1)
            node = children[node][byte]
        values[node] = value
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = -2
    low, todo = 1, [(0, 0)]
    while todo:
        node, state = todo.pop()
        value[state] = values[node]
        if not children[node]:
            continue
        bytes_ = list(children[node])
        while check[low] != -1:
            low += 1
        first, tries = max(1, low - bytes_[0]), 0
        while True:
            if first + 256 >= len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            if all(check[first + c] == -1 for c in bytes_):
                break
            first, tries = first + 1, tries + 1
        if tries > 64:  # the holes passed by are too few to be worth another look
            low = first + bytes_[0]
        base[state] = first
        for c in bytes_:
            check[first + c] = state
            todo.append((children[node][c], first + c))
    # States without children must lead nowhere, whatever the byte.
    return (
        np.array(base + [0] * 256, np.int64),
        np.array(check + [-1] * 256, np.int64),
        np.array(value + [-1] * 256, np.int64),
    )


class Pieces:
    """A model's pieces as arrays; built once on the driver and sent to the tasks."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        text, normal = [], {}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                text.append(bytes([int(piece[3:5], 16)]))
                self.byte_ids[text[-1][0]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text.append(b"")
            else:
                if MARKER in piece.lstrip(MARKER):
                    raise ValueError(f"piece {i} has a marker inside: chunks would not be independent")
                # A marker stands for a space, so pieces are kept as they match the text.
                text.append(piece.replace(MARKER, " ").encode())
                normal[text[-1]] = i
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.sizes = np.array([len(t) for t in text])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.longest = max(map(len, normal), default=0)
        self.unknown = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.base, self.check, self.value = double_array(normal)

    def split(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Best splits of the chunks [begin, end): ids, their number and the score of each chunk."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        shift = np.cumsum(size + 1) - (size + 1)  # of each chunk's positions
        score = np.full(int((size + 1).sum()), -np.inf)
        score[shift] = 0.0
        back = np.zeros(len(score), np.int64)  # bytes of the best piece that ends here
        piece = np.full(len(score), -1, np.int64)
        live = len(size)
        for i in range(int(size[0]) if len(size) else 0):
            while size[live - 1] <= i:
                live -= 1
            from_ = shift[:live] + i
            on = np.flatnonzero(score[from_] > -np.inf)
            if not len(on):
                continue
            at, left, here = begin[on] + i, size[on] - i, from_[on]
            char = np.minimum(_CHAR[data[at]], left)
            covered = np.zeros(len(on), bool)
            who, state = np.arange(len(on)), np.zeros(len(on), np.int64)
            for j in range(self.longest):
                to = self.base[state] + data[at[who] + j]
                ok = (self.check[to] == state) & (self.base[state] > 0)
                who, state = who[ok], to[ok]
                found = self.value[state]
                good = np.flatnonzero(found >= 0)
                w, f = who[good], found[good]
                covered[w[char[w] == j + 1]] = True
                self._better(score, back, piece, here[w], j + 1, score[here[w]] + self.scores[f], f)
                more = left[who] > j + 1
                who, state = who[more], state[more]
                if not len(who):
                    break
            w = np.flatnonzero(~covered)
            self._better(score, back, piece, here[w], char[w], score[here[w]] + self.unknown, -1)
        # Marks the ends of the best pieces, from the back of all chunks at once.
        mark = np.zeros(len(score), bool)
        end_at = shift + size
        total = score[end_at]
        now, stop = end_at[size > 0], shift[size > 0]
        while len(now):
            mark[now] = True
            now = now - back[now]
            more = now > stop
            now, stop = now[more], stop[more]
        ends = np.flatnonzero(mark)
        known = piece[ends] >= 0
        count = np.where(known, 1, back[ends])
        ids = np.empty(int(count.sum()), np.int64)
        to = np.cumsum(count) - count
        ids[to[known]] = piece[ends[known]]
        chunk = np.searchsorted(shift, ends, "right") - 1
        plain = np.flatnonzero(~known)
        source = begin[chunk[plain]] + (ends[plain] - back[ends[plain]]) - shift[chunk[plain]]
        ids[ragged(to[plain], count[plain])] = self.byte_ids[data[ragged(source, count[plain])]]
        per = np.bincount(chunk, count, len(size)).astype(np.int64)
        # Back to the order in which the chunks came.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        run = np.cumsum(per) - per
        return ids[ragged(run[place], per[place])].astype(np.int32), per[place], total[place]

    @staticmethod
    def _better(score, back, piece, here, step, got, found):
        to = here + step
        up = got > score[to]
        at = to[up]
        score[at] = got[up]
        back[at] = step[up] if np.ndim(step) else step
        piece[at] = found[up] if np.ndim(found) else found

    def encode(self, data: np.ndarray, offsets: np.ndarray, memo: Memo):
        """All rows' ids one after the other, row offsets into them, and each row's score."""
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[:-1][full], 32)
        shift = np.zeros(len(offsets), np.int64)
        shift[full + 1] = 1
        offsets = offsets + np.cumsum(shift)
        n = len(offsets) - 1
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n)
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][full]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        keys, at, inverse = distinct(span_hashes(data, begin, end))
        b, e = begin[at], end[at]
        place = memo.places(keys, lambda new: self.split(data, b[new], e[new]))[inverse]
        size = memo.sizes[place]
        row = np.searchsorted(offsets, begin, "right") - 1
        flat = memo.flat[ragged(memo.starts[place], size)]
        per = np.bincount(row, size, n).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(per)]), np.bincount(row, memo.figures[place], n)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text bytes of all rows and their offsets; the marker before each text is left out."""
        size = self.sizes[ids]
        data = self.text[ragged(self.starts[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        full = np.flatnonzero(np.diff(ends))
        first = ends[:-1][full]
        drop = first[data[first] == 32]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[drop + 1] = 1
        return np.delete(data, drop), ends - np.cumsum(gone)[ends]


@lru_cache(maxsize=2)
def model_path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


def _valid(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, score)``, one row per input row: the pieces and the sum of their scores.

    Null and empty text have no pieces and score 0. Other columns are ignored.
    """
    made = docs.sparkSession.sparkContext.broadcast(Pieces(model_path(model)))  # size of the model

    def run(batches):
        pieces, memo = made.value, Memo(np.int32, _CACHED)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets, score = pieces.encode(*text_column(part.column("text")), memo)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(score)], ["doc_id", "ids", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, score double")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``: the text of ``ids``; null ids give null. Bytes that are no UTF-8
    become U+FFFD. Control and unknown pieces give nothing."""
    made = encoded.sparkSession.sparkContext.broadcast(Pieces(model_path(model)))
    columns = [c for c in encoded.columns if c != "text"]
    packed = encoded.select("ids", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
            flat = ids.drop_null().flatten().to_numpy(zero_copy_only=False)
            step = 200_000  # ids at once
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + step, "right")) - 1)
                at = offsets[begin : end + 1]
                texts = _valid(*made.value.decode(flat[at[0] : at[-1]], at - at[0]))
                valid = ids.slice(begin, end - begin).is_valid()
                text = pc.if_else(valid, pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(begin, end - begin), text], ["row", "text"])
                begin = end

    out = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("text", StringType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "text")


@query("op9_sentencepiece")
def op9(spark, folder):
    """Every document's pieces, and the digest of the text that they decode to."""
    both = decode(encode(table(spark, folder, "documents")))
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "score", F.sha2("text", 256).alias("text_sha256")
    )
