"""Byte-level BPE ids of whole text columns.

The ids are those of the ``tokenizers`` file at ``path``. As text repeats its words, each distinct
chunk (white space and the word behind it) of a slice is encoded once, by the same vocabulary's
ranks, kept for the next slices, and the ids are put together with numpy. A chunk stands alone because the vocabulary's
pattern always splits between a word and the white space behind it; texts with other white space
than ASCII's, or with a special token's string, are encoded whole by ``tokenizers``.
"""

from __future__ import annotations

import base64
import json
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from listwright.llm.text import SPACE, Memo, distinct, ragged, span_hashes, words

PATH = "byte_bpe_50k"
_CACHED = 200_000
# UTF-8 lead bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000.., U+3000).
_OTHER_SPACE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]


class Encoder:
    def __init__(self, json_path: str, ranks_path: str):
        self.json_path = json_path
        with open(json_path) as file:
            self.special = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.chunks = tiktoken.Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.bytes_of[number] = len(token)
        self.memo = Memo(np.uint16, _CACHED)

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.json_path)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, one after the other, and the row offsets into them."""
        n = len(offsets) - 1
        first, last, word = words(data, offsets)
        counts = np.diff(word)
        row = np.repeat(np.arange(n), counts)
        begin = np.empty(len(first), np.int64)
        begin[1:] = last[:-1]
        heads = word[:-1][counts > 0]
        begin[heads] = offsets[:-1][counts > 0]
        # White space behind a row's last word, or all of a row without words.
        tail = offsets[:-1].copy()
        tail[counts > 0] = last[word[1:][counts > 0] - 1]
        ends = np.flatnonzero(tail < offsets[1:])
        row = np.concatenate([row, ends])
        begin = np.concatenate([begin, tail[ends]])
        last = np.concatenate([last, offsets[1:][ends]])
        order = np.argsort(row, kind="stable")
        row, begin, last = row[order], begin[order], last[order]

        odd = self._odd(data, offsets)
        if odd.any():
            stay = ~odd[row]
            row, begin, last = row[stay], begin[stay], last[stay]
        start, size = self._chunk_ids(data, begin, last)
        flat = self.memo.flat[ragged(start, size)]
        per_row = np.bincount(row, size, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        if odd.any():
            flat, per_row = self._with_whole(data, offsets, odd, flat, per_row)
        return flat, np.concatenate([[0], np.cumsum(per_row)])

    def _chunk_ids(self, data, begin, end):
        """Where each chunk's ids are in the memo, and how many."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at, inverse = distinct(span_hashes(data, begin, end))
        begin, end = begin[at], end[at]
        place = self.memo.places(keys, lambda new: self._encoded(data, begin[new], end[new]))[inverse]
        return self.memo.starts[place], self.memo.sizes[place]

    def _encoded(self, data, begin, end):
        """Ids of chunks. Those that begin with white space and end with a word do not touch each
        other's ids, so they are encoded as one text and told apart by the bytes of each id."""
        encode = self.chunks.encode_ordinary
        joined = SPACE[data[begin]] & ~SPACE[data[end - 1]]
        size = np.zeros(len(begin), np.int64)
        start = np.zeros(len(begin), np.int64)
        one = data[ragged(begin[joined], (end - begin)[joined])].tobytes().decode("utf-8", "replace")
        together = np.array(encode(one), np.uint16)
        ends = np.searchsorted(np.cumsum(self.bytes_of[together]), np.cumsum((end - begin)[joined]), "left") + 1
        size[joined] = np.diff(ends, prepend=0)
        start[joined] = ends - size[joined]
        alone = []
        for i in np.flatnonzero(~joined).tolist():
            found = encode(data[begin[i] : end[i]].tobytes().decode("utf-8", "replace"))
            start[i], size[i] = len(together) + len(alone), len(found)
            alone.extend(found)
        flat = np.concatenate([together, np.array(alone, np.uint16)])
        return flat[ragged(start, size)], size, np.zeros(len(size))

    def _odd(self, data, offsets):
        """Rows whose chunks cannot stand alone."""
        odd = np.zeros(len(offsets) - 1, bool)
        spots = []
        for a, b in _OTHER_SPACE:
            lead = np.flatnonzero(data[:-1] == a)
            spots.append(lead[data[lead + 1] == b])
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                spots.append(np.array([at]))
                at = raw.find(mark, at + 1)
        spots = np.concatenate(spots)
        odd[np.searchsorted(offsets, spots, "right") - 1] = True
        return odd

    def _with_whole(self, data, offsets, odd, flat, per_row):
        parts = np.split(flat, np.cumsum(per_row)[:-1])
        for i in np.flatnonzero(odd):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            parts[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
            per_row[i] = len(parts[i])
        return np.concatenate(parts), per_row


@lru_cache(maxsize=2)
def encoder(name: str = PATH) -> Encoder:
    """One per Python worker; ``name`` is the vocabulary's, or the path without its ending."""
    def place(ending):
        return name + ending if "/" in name else public_tokenizers.path(name + ending)

    return Encoder(place(".json"), place(".tiktoken"))
