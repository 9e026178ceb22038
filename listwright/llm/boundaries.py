"""Where a byte-level BPE vocabulary's pattern cuts text, found without running the pattern.

The pattern is ``public_tokenizers.PATTERN``: contractions, then runs of letters, of numbers or of
other characters, each with one space in front, then white space, whose last character is left to
what follows it. Every code point becomes one of a few symbols, by a table of classes and its next
neighbours. The rest is an automaton of eight states, and a symbol is a function from the state before
to the state behind it. Functions compose associatively, and only a few hundred different ones arise, so
they are numbered once with a table of their products. A scan then gives the state before every code
point of a slice: products of blocks, a scan over the blocks' products, and a pass through all
blocks at once from the state each begins in. A row's first symbol is a constant function, so all
rows of a slice are one scan.
"""

from __future__ import annotations

import numpy as np
import tiktoken

LETTER, NUMBER, SPACE, OTHER = range(4)

# Symbols: the four classes (a SPACE that more white space or the row's end follows), contractions
# of two and three characters, and white space before another character: U+0020, or another one.
PAIR, TRIPLE, JOINED, SINGLE = 4, 5, 6, 7
SYMBOLS = 8
# States: within a run, behind a space that belongs to what follows, behind a whole piece, and
# inside a contraction with one or two characters to come.
IN_LETTERS, IN_NUMBERS, IN_SPACES, IN_OTHERS, AFTER_SPACE, DONE, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 64


def class_table() -> np.ndarray:
    """The class of every code point, one byte each, as the tokenizer library itself sees them: its
    Unicode version may be newer than Python's."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for kind, one in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=one, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins with this character."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return DONE, False
    plain = OTHER if symbol in (PAIR, TRIPLE) else symbol
    # Behind a joining space, or within other characters, an apostrophe is one of these.
    if state in (AFTER_SPACE, IN_OTHERS) and plain == OTHER:
        return IN_OTHERS, False
    for run, kind in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_SPACES, SPACE)):
        if symbol == kind and (state == run or (state == AFTER_SPACE and kind != SPACE)):
            return run, False
    begun = (IN_LETTERS, IN_NUMBERS, IN_SPACES, IN_OTHERS, ONE_LEFT, TWO_LEFT, AFTER_SPACE, DONE)
    return begun[symbol], True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that arise, as ``(maps, products, generators, begins)``: where each leads from each
    state, the number of one after the other, the numbers of the symbols (and of the same ones at a
    row's start), and whether a symbol begins a piece, by state."""
    steps = [[_step(state, symbol) for state in range(8)] for symbol in range(SYMBOLS)]
    first = [tuple(to for to, _ in row) for row in steps]
    first += [(row[DONE][0],) * 8 for row in steps]
    number = {tuple(range(8)): 0}
    for made in first:
        number.setdefault(made, len(number))
    done = 0
    while done < len(number):  # closed under one more symbol
        known = list(number)
        for before in known[done:]:
            for then in first:
                number.setdefault(tuple(then[state] for state in before), len(number))
        done = len(known)
    maps = np.array(list(number), np.uint8)
    products = np.array([[number[tuple(b[a])] for b in maps] for a in maps], np.uint8 if len(maps) <= 256 else np.uint16)
    begins = np.array([[begins for _, begins in row] for row in steps])
    return maps, products, np.array([number[made] for made in first], products.dtype), begins


_MAPS, _PRODUCTS, _GENERATORS, _BEGINS = _monoid()
_FLAT, _MANY = _PRODUCTS.ravel(), len(_PRODUCTS)


def scan(functions: np.ndarray) -> np.ndarray:
    """For each place the product of all functions before it."""
    n = len(functions)
    if n <= BLOCK:
        out, now = np.empty(n, _PRODUCTS.dtype), 0
        for i in range(n):
            out[i] = now
            now = _PRODUCTS[now, functions[i]]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, _PRODUCTS.dtype)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    whole = columns[0].astype(np.int64)
    for column in columns[1:]:
        whole = _FLAT[whole * _MANY + column].astype(np.int64)
    now = scan(whole.astype(_PRODUCTS.dtype)).astype(np.int64)
    out = np.empty_like(columns)
    for i, column in enumerate(columns):
        out[i] = now
        now = _FLAT[now * _MANY + column].astype(np.int64)
    return np.ascontiguousarray(out.T).ravel()[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and values of the code points. Bytes that are no UTF-8 get some value or other."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.int32)
    points = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((lead >= least) & (lead < most))
        value = lead[some] & mask
        for k in range(1, more + 1):
            value = value << 6 | (padded[starts[some] + k] & 0x3F)
        points[some] = value
    return starts, np.minimum(points, 0x10FFFF)


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte starts of all pieces of the rows; a row that has text begins a piece."""
    starts, points = code_points(data)
    if not len(starts) or starts[0]:  # bytes that are no UTF-8 before the first character
        starts, points = np.concatenate([[0], starts]), np.concatenate([[0xFFFD], points]).astype(np.int32)
    if not len(data):
        return np.zeros(0, np.int64)
    heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
    at = np.searchsorted(starts, heads)
    missing = starts[np.minimum(at, len(starts) - 1)] != heads
    if missing.any():  # a row whose first byte is no character's first
        starts = np.insert(starts, at[missing], heads[missing])
        points = np.insert(points, at[missing], 0xFFFD)
        at = np.searchsorted(starts, heads)
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[at] = True
    head[n] = True
    symbol = classes[points]
    space = symbol == SPACE
    before_text = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
    symbol[before_text] = np.where(points[before_text] == 0x20, JOINED, SINGLE)
    # Contractions: fixed by the pattern.
    mark = np.flatnonzero(points == ord("'"))
    one = np.where(head[mark + 1], 0, points[np.minimum(mark + 1, n - 1)])
    two = np.where(head[mark + 1] | head[np.minimum(mark + 2, n)], 0, points[np.minimum(mark + 2, n - 1)])
    symbol[mark[np.isin(one, [ord(c) for c in "stmd"])]] = PAIR
    for a, b in ("re", "ve", "ll"):
        symbol[mark[(one == ord(a)) & (two == ord(b))]] = TRIPLE
    functions = _GENERATORS[symbol + np.where(head[:n], SYMBOLS, 0).astype(np.uint8)]
    state = _MAPS[scan(functions), DONE]
    return starts[_BEGINS[symbol, np.where(head[:n], DONE, state)]]
