import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.llm.text import distinct, ragged, slices, span_hashes, text_column, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nab\x0bé😀\x85", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = text_column(pa.array(texts, pa.string()))
    starts, ends, first = words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first, first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_slices_hold_all_rows_in_order(texts, limit):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    parts = list(slices(batch, "text", limit))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= limit for p in parts)


def test_hashes_tell_spans_apart():
    spans = [b"a" * n for n in range(1, 40)] + [b"a\0", b"a\0\0", b"abcdefgh", b"abcdefghi", b"abcdefgi"]
    data = np.frombuffer(b"".join(spans) + b"abcdefgh", np.uint8)
    ends = np.cumsum([len(s) for s in spans] + [8])
    starts = np.concatenate([[0], ends[:-1]])
    found = span_hashes(data, starts, ends)
    assert len(set(found[:-1].tolist())) == len(spans)
    assert found[-1] == found[len(spans) - 3]


def test_distinct_and_ragged():
    keys, at, inverse = distinct(np.array([5, 3, 5, 9], np.uint64))
    assert keys.tolist() == [3, 5, 9] and keys[inverse].tolist() == [5, 3, 5, 9] and at[0] == 1
    assert ragged(np.array([4, 0, 7]), np.array([2, 0, 3])).tolist() == [4, 5, 7, 8, 9]
