import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listwright.llm import boundaries, byte_bpe, packing, pieces
from listwright.llm.text import Memo, text_column
from listwright.llm.tokens import encoder

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é😀'sl \n\t\xa0\x85\u30000１▁<|endoftext|>"), max_size=40)), max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_tokenizer(texts):
    whole = tokenizer()
    flat, offsets = encoder().ids(*text_column(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def tokenizer(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return kept[0]


def test_packing_places_every_piece_once(docs):
    random.seed(1)
    rows = [(i, " ".join(random.choice(["alpha", "beta", "é", "x\n"]) for _ in range(random.choice([0, 3, 100, 700, 1500, 4000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a <|endoftext|> b"), (None, "no id"), rows[4], (503, "word " * 60_000)]
    got = packing.pack(docs(rows), with_ids=True).collect()
    encode = lambda t: [*tokenizer().encode(t or "", add_special_tokens=False).ids, 2]
    want = Counter()
    for i, text in rows:
        ids = encode(text)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(sequences) <= 1.05 * least + 1
    assert packing.pack(docs([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_patterns_hold_the_histogram(counts):
    histogram = np.zeros(33, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    found = packing.pattern_counts(histogram, 32)
    used = Counter()
    for lengths, n in found:
        assert sum(lengths) <= 32 and n > 0
        for v in lengths:
            used[v] += n
    assert used == Counter({k: v for k, v in counts.items()})


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path(pieces.MODEL))


def brute(model, text):
    """The plain Viterbi over a dictionary of pieces."""
    if not text:
        return []
    raw = (" " + text).encode()
    known = {model.text[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(model.starts, model.sizes)) if n and i not in set(model.byte_ids.tolist())}
    best, back = [0.0] + [-np.inf] * len(raw), [None] * (len(raw) + 1)
    at = 0
    while at < len(raw):
        char = int(pieces._CHAR[raw[at]])
        single = False
        for end in range(at + 1, min(len(raw), at + model.longest) + 1):
            i = known.get(raw[at:end])
            if i is not None:
                single |= end - at == char
                if best[at] + model.scores[i] > best[end]:
                    best[end], back[end] = best[at] + model.scores[i], (at, [i])
        if not single and best[at] + model.unknown > best[at + char]:
            best[at + char], back[at + char] = best[at] + model.unknown, (at, [int(model.byte_ids[b]) for b in raw[at : at + char]])
        at += char
    out, end = [], len(raw)
    while end:
        end, ids = back[end][0], back[end][1]
        out = ids + out
    return out


def test_pieces_against_plain_viterbi(model):
    rng = random.Random(2)
    texts = [None, "", " ", "  a  b ", "▁x ▁▁", "😀é\x00\n\t", "w" * 300, "naïve Über straße", "中文 mixed 😀😀"]
    texts += ["".join(rng.choice("the and of ing é😀\n▁zq") for _ in range(rng.randrange(60))) for _ in range(40)]
    data, offsets = text_column(pa.array(texts))
    flat, at, score = model.encode(data, offsets, Memo(np.int32, 10))
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == brute(model, text), text
    back, ends = model.decode(flat, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [t or "" for t in texts]


def test_double_array_holds_exactly_its_keys():
    keys = {bytes(k): i for i, k in enumerate([b"a", b"ab", b"abc", b"b", b"\xff\x00", b"ac", b"abd"])}
    base, check, value = pieces.double_array(keys)

    def find(key):
        state = 0
        for byte in key:
            to = base[state] + byte
            if base[state] <= 0 or check[to] != state:
                return None
            state = to
        return value[state]

    assert all(find(k) == i for k, i in keys.items())
    assert find(b"abe") is None and find(b"c") is None and find(b"\xff") == -1


def test_round_trip_of_documents(spark, docs):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "▁"), (1, "again"), (4, "é " * 50_000)]
    encoded = pieces.encode(docs(rows))
    got = Counter((r.doc_id, r.text) for r in pieces.decode(encoded).collect())
    assert got == Counter((i, t or "") for i, t in rows)
    assert pieces.encode(docs([])).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "text int, ids array<int>")
    assert {(r.ids is None, r.text) for r in pieces.decode(odd).collect()} == {(True, None), (False, "")}


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(byte_bpe.ranks_path(byte_bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


# Contractions whole and cut, white space of all kinds, marks, numbers that are no digits, letters newer than Python's.
MARKS = ["'", "s", "t", "re", "ve", "r", "l", "ll", "d", "m", "'S", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000",
         "a", "B", "é", "中", "1", "２", "½", "!", "😀", "\u0301", "\ua7cd", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(MARKS), max_size=50).map("".join), st.text(max_size=20)), max_size=6))
def test_byte_bpe_is_the_librarys(ranks, library, texts):
    flat, offsets = ranks.encode(*text_column(pa.array(texts, pa.string())), Memo(np.int32, 10))
    starts = ranks.byte_starts(flat, offsets)
    for i, text in enumerate(texts):
        ids = flat[offsets[i] : offsets[i + 1]].tolist()
        assert ids == library.encode_ordinary(text or "")
        at = np.cumsum([0, *[len(library.decode_single_token_bytes(t)) for t in ids]])
        assert starts[offsets[i] : offsets[i + 1]].tolist() == at[:-1].tolist()
    back, ends = ranks.decode(flat, offsets)
    assert [back[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [t or "" for t in texts]


def test_long_pieces_are_merged_alike(ranks, library):
    texts = ["w" * 300, "ab" * 5000, "!" * 1000, " " * 1000 + "x", "thequickbrownfox" * 40, "é" * 33, "x" * 32, "'" * 70 + "s"]
    flat, offsets = ranks.encode(*text_column(pa.array(texts)), Memo(np.int32, 10))
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_automaton():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, boundaries.SYMBOLS, 5000)
    state, want = boundaries.DONE, []
    for symbol in symbols.tolist():
        want.append(state)
        state = boundaries._step(state, symbol)[0]
    got = boundaries.scan(boundaries._GENERATORS[symbols])
    assert boundaries._MAPS[got, boundaries.DONE].tolist() == want
    # Products are associative.
    a, b, c = rng.integers(0, len(boundaries._MAPS), (3, 200))
    times = boundaries._PRODUCTS
    assert (times[times[a, b], c] == times[a, times[b, c]]).all()


def test_byte_bpe_of_documents(spark, docs, library):
    rows = [(1, "Don't  stop\n"), (2, None), (3, ""), (None, "we've 12½"), (1, "Don't  stop\n"), (4, "é " * 50_000), (5, "q" * 200_000)]
    encoded = byte_bpe.encode(docs(rows))
    assert encoded.columns == ["doc_id", "mark", "row", "n_chars", "spans", "ids", "starts"]
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.bytes).decode()) for r in byte_bpe.decode(encoded).collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), t or "") for i, t in rows)
    assert byte_bpe.encode(docs([])).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "bytes int, ids array<int>")
    assert {(r.ids is None, r.bytes) for r in byte_bpe.decode(odd).collect()} == {(True, None), (False, b"")}


def test_op12_query(spark, library):
    from listwright.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
