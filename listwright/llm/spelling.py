"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, and what they stem from.

Words are vectors of letter counts. One edit changes a squared distance of such vectors by one (another
length) or two (another letter), so near words lie in blocks of equal or adjacent length; blocks are
divided further by the counts of a few groups of letters, which one edit changes by one each. For every
two blocks that an edit can join, one matrix product gives all squared distances between their words,
and pairs that are close enough are compared letter by letter. Blocks are cut into parts of bounded
size, and two parts are one piece of work, so a block of any size spreads over the cluster.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.registry import query, table
from listwright.llm.text import LOWER, distinct, ragged, slices, span_hashes, text_column
from listwright.sources.storage import cut

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
DELETE = 31  # one occurrence in so many loses a letter, see ``word_counts``

# Every letter a word may hold: fixed by the pattern [A-Za-zÀ-ÿ] and lower-cased A-Z.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
# Words of a part of a block, and letters of all its words together.
PART, PART_LETTERS = 1024, 1 << 16
# Words that share a block with a word, on the average, for which blocks are small enough.
CROWD = 1500
MOST_GROUPS = 8
_LONG = 256  # bytes of a run whose checksum is taken alone
_SLICE = 4 << 20

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the byte spans [begin, end), each going on from the crc32 ``before`` it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    size = end - begin
    live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        now = state[live]
        state[live] = _CRC[(now ^ data[begin[live] + at]) & 0xFF] ^ (now >> 8)
        at += 1
        live = live[size[live] > at]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), int(before[i]))
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all maximal runs of letters, and their rows."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF: this byte and one more
    letter[lead] = True
    letter[np.minimum(lead + 1, len(data) - 1)] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    begin = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def _counted(least: int, delete: int):
    def one(part: pa.RecordBatch):
        raw, offsets = text_column(part.column("text"))
        if not len(raw):
            return None
        begin, end, row = _runs(raw, offsets)
        data = LOWER[raw]
        wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
        length = end - begin - (wide[end] - wide[begin])
        some = np.flatnonzero(length >= least)
        begin, end, row, length = begin[some], end[some], row[some], length[some]
        ids = part.column("id").fill_null("").to_pylist()
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        chosen = checksums(data, begin, end, before[row]) if delete else np.zeros(0, np.uint32)
        hit = np.flatnonzero(chosen % delete == 0) if delete else np.zeros(0, np.int64)
        cut_words = []
        for i in hit[length[hit] > least].tolist():
            word = data[begin[i] : end[i]].tobytes().decode()
            at = int(chosen[i]) % len(word)
            cut_words.append((word[:at] + word[at + 1 :]).encode())
        stay = np.ones(len(begin), bool)
        stay[hit] = False
        begin, end = begin[stay], end[stay]
        if cut_words:  # the changed words stand behind the text
            size = np.array([len(w) for w in cut_words])
            stop = len(data) + np.cumsum(size)
            data = np.concatenate([data, np.frombuffer(b"".join(cut_words), np.uint8)])
            begin, end = np.concatenate([begin, stop - size]), np.concatenate([end, stop])
        if not len(begin):
            return None
        _, at, inverse = distinct(span_hashes(data, begin, end))
        n = np.bincount(inverse, minlength=len(at))
        size = end[at] - begin[at]
        found = pa.Array.from_buffers(
            pa.string(),
            len(at),
            [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(data[ragged(begin[at], size)].tobytes())],
        )
        return pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], ["word", "n"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                made = one(part)
                if made is not None:
                    yield made

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, delete: int = 0) -> DataFrame:
    """``(word, n)``: all runs of letters of at least ``least`` code points, A-Z lower-cased.

    With ``delete``, occurrences whose crc32 of ``<doc_id>:<word>`` it divides first lose the letter at that
    number modulo their length; a null doc_id counts as empty there. Null and empty texts have no
    words. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    return rows.mapInArrow(_counted(least, delete), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _groups(letters: dict[str, int], k: int) -> list[str]:
    """All letters dealt to ``k`` groups, the frequent ones first, each to the lightest group."""
    weight, members = [0] * k, [""] * k
    for c in sorted(LETTERS, key=lambda c: (-letters.get(c, 0), c)):
        g = weight.index(min(weight))
        weight[g] += letters.get(c, 0)
        members[g] += c
    return members


def _keyed(words: DataFrame, groups: list[str]) -> DataFrame:
    """Words with ``g0, g1, …``: how many letters of each group they have."""
    counts = []
    for i, own in enumerate(groups):
        others = "".join(c for c in LETTERS if c not in own)
        counts.append((F.length(F.translate("word", others, "")) if others else F.length("word")).alias(f"g{i}"))
    return words.select("word", "n", *counts)


def _blocks(words: DataFrame, part: int) -> tuple[DataFrame, int]:
    """``(g0, g1, …, part, parts, words, ns)``: the words of every part of a block, sorted; and how many
    groups of letters tell blocks apart, as many as make them small."""
    total = words.count()
    letters = {
        r["c"]: r["n"]
        for r in words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    k = max(1, int(math.log(max(total / 1000, 1)) / math.log(4.5)))
    while True:
        keys = [f"g{i}" for i in range(k)]
        keyed = _keyed(words, _groups(letters, k))
        sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"))
        crowd = (sizes.agg(F.sum(F.col("n_words") * F.col("n_words"))).first()[0] or 0) / max(total, 1)
        if crowd <= CROWD or k == MOST_GROUPS:
            break
        k += 1
    length = sum((F.col(g) for g in keys), F.lit(0))
    at_once = F.greatest(F.lit(1), F.least(F.lit(part), F.floor(F.lit(PART_LETTERS) / length)))
    parts = sizes.select(*keys, F.ceil(F.col("n_words") / at_once).cast("int").alias("parts"))
    blocks = (
        keyed.join(parts, keys)
        .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        .groupBy(*keys, "part", "parts")
        .agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows"))
    )
    return cut(blocks.select(*keys, "part", "parts", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"))), k


def _steps(k: int) -> list[tuple[int, ...]]:
    """How an edit may change a block's key, one of each two opposite ways: not at all, one letter more
    in a group, or one more in a group and one less in a later one."""
    def step(*changes):
        return tuple(sum(by for g, by in changes if g == i) for i in range(k))

    return [step(), *(step((i, 1)) for i in range(k)), *(step((i, 1), (j, -1)) for i in range(k) for j in range(i + 1, k))]


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of word lists: one byte per letter, each list's first letter, its first word, and all words."""
    lists = column.offsets.to_numpy().astype(np.int64)
    words = column.values.slice(lists[0], lists[-1] - lists[0])
    data, offsets = text_column(words)
    lead = data == 0xC3
    gone = np.concatenate([[0], np.cumsum(lead)])
    codes = np.where(data >= 0x80, data + np.uint8(0x40), data)[~lead]
    return codes, (offsets - gone[offsets])[lists - lists[0]], lists - lists[0], words


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of ``a`` and ``b`` that one edit tells apart, by matrices of letters. ``b`` is as long
    as ``a`` or one longer; with ``same`` both are one block, and a pair is given once."""
    used = np.flatnonzero(np.bincount(a.ravel(), minlength=256) + np.bincount(b.ravel(), minlength=256))
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))
    kind = np.float32 if a.shape[1] < 2000 else np.float64  # squares stay exact

    def counts(m):
        cells = (np.arange(len(m)) * len(used))[:, None] + place[m]
        return np.bincount(cells.ravel(), minlength=len(m) * len(used)).reshape(len(m), -1).astype(kind)

    x, y = counts(a), counts(b)
    one = np.ones((1, 1), kind)
    left = np.hstack([x, (x * x).sum(axis=1, keepdims=True), np.broadcast_to(one, (len(x), 1))])
    right = np.hstack([-2 * y, np.broadcast_to(one, (len(y), 1)), (y * y).sum(axis=1, keepdims=True)])
    distance = left @ right.T
    longer = b.shape[1] > a.shape[1]
    # At most two; words as long as each other are two apart, and others one, if one edit tells them apart.
    at = np.flatnonzero((distance == (1 if longer else 2)).ravel())
    i, j = at // len(y), at % len(y)
    if same:
        i, j = i[i < j], j[i < j]
    if longer:
        size = a.shape[1]
        front = np.cumprod(a[i] == b[j][:, :size], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        back = np.cumprod(a[i][:, ::-1] == b[j][:, :0:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        good = front + back >= size
    else:
        good = (a[i] != b[j]).sum(axis=1) == 1
    return i[good], j[good]


def _best(own: np.ndarray, other: np.ndarray, ns: np.ndarray):
    """For each place in ``own`` how many others it meets, and which is the most frequent, the first of equal ones."""
    order = np.lexsort((other, -ns[other], own))
    own, other = own[order], other[order]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[new], np.diff(np.append(new, len(own))), other[new]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = np.asarray(batch.column("same").to_numpy(zero_copy_only=False), bool)
        sides = [_letters(batch.column(f"{s}_words")) for s in "ab"]
        counts = [np.asarray(batch.column(f"{s}_ns").flatten(), np.int64) for s in "ab"]
        found: list[list[np.ndarray]] = [[], [], [], []]  # side a's word and n_near and best, then side b's
        rows: list[tuple[np.ndarray, ...]] = []
        for r in range(batch.num_rows):
            (ca, la, wa, _), (cb, lb, wb, _) = sides
            a = ca[la[r] : la[r + 1]].reshape(wa[r + 1] - wa[r], -1)
            b = cb[lb[r] : lb[r + 1]].reshape(wb[r + 1] - wb[r], -1)
            i, j = near_pairs(a, b, bool(same[r]))
            if len(i):
                i, j = i + wa[r], j + wb[r]
                rows.append((*_best(i, j, counts[1]), *_best(j, i, counts[0])))
        if not rows:
            continue
        found = [np.concatenate(x) for x in zip(*rows)]
        for (own, many, best), words, others, ns in (
            (found[:3], sides[0][3], sides[1][3], counts[1]),
            (found[3:], sides[1][3], sides[0][3], counts[0]),
        ):
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(own)), pa.array(many, pa.int64()), pa.array(-ns[best]), others.take(pa.array(best))],
                ["word", "n_near", "less", "near"],
            )


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """``(word, n_near, near, near_n)`` of the words (of ``word, n``, each once) that have a near one: how
    many those are, and the most frequent of them, of equal ones the first in code-point order."""
    blocks, k = _blocks(words, part)
    keys = [f"g{i}" for i in range(k)]
    steps = _steps(k)
    known = blocks.select(*keys, "parts").distinct()
    targets = F.explode(F.array(*[F.struct(F.lit(i == 0).alias("same_block"), *[(F.col(g) + s[n]).alias(g) for n, g in enumerate(keys)]) for i, s in enumerate(steps)]))
    visits = (
        blocks.select(F.struct(*keys).alias("home"), F.col("part").alias("a_part"), targets.alias("t"))
        .select("home", "a_part", "t.*")
        .join(known, keys)
        .withColumn("part", F.explode(F.sequence(F.when(F.col("same_block"), F.col("a_part")).otherwise(0), F.col("parts") - 1)))
        .select("home", "a_part", *keys, "part", (F.col("same_block") & (F.col("a_part") == F.col("part"))).alias("same"))
    )
    visitors = blocks.select(F.struct(*keys).alias("home"), F.col("part").alias("a_part"), F.col("words").alias("a_words"), F.col("ns").alias("a_ns"))
    # Work is even for each part that is visited, so it is spread by a fixed number of partitions.
    spread = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 50)
    left = visits.join(visitors, ["home", "a_part"]).drop("home", "a_part").repartition(spread, *keys, "part")
    right = blocks.select(*keys, "part", F.col("words").alias("b_words"), F.col("ns").alias("b_ns")).repartition(spread, *keys, "part")
    both = left.join(right, [*keys, "part"]).select("same", "a_words", "a_ns", "b_words", "b_ns")
    found = both.mapInArrow(_compared, "word string, n_near bigint, less bigint, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def spelling_groups(words: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of ``words(word, n)``.

    A word's form is its most frequent near word if that is ``ratio`` times as frequent; its root is where
    forms lead in the end. ``ratio`` must be at least 2, so that forms cannot go in a circle.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    near = near_words(words, part)
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct("near", "near_n"))
    named = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form["near"].alias("form"), form["near_n"].alias("form_n")
        )
    )
    # Each round doubles how far a word has gone; counts rise by ``ratio`` a step, so rounds are few.
    going = named.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    rounds = math.ceil(math.log2(max(1, 63 / math.log2(ratio)))) + 1
    for _ in range(rounds):
        nexts = going.select(F.col("word").alias("to"), F.col("to").alias("further"))
        going = going.join(nexts, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        going = cut(going)
        if not going.where("moved").limit(1).count():
            break
        going = going.drop("moved")
    roots = going.select("word", F.col("to").alias("root"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


@query("op11_spelling_variants")
def op11(spark, folder):
    counts = word_counts(table(spark, folder, "documents"), LEAST_LENGTH, DELETE)
    return spelling_groups(cut(counts.where(F.col("n") >= LEAST_COUNT)))
