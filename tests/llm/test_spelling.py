import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from listwright.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows, least=7, delete=31):
    out = Counter()
    for i, text in rows:
        for word in RUN.findall(text or ""):
            word = word.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if delete and h % delete == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                out[word] += 1
    return out


def grouped(counts, ratio=10):
    """The plain comparison of all pairs that share a spelling with one letter left open or taken out."""
    near, open_ = defaultdict(set), defaultdict(list)
    for w in counts:
        for k in range(len(w)):
            open_[w[:k] + "\0" + w[k + 1 :]].append(w)
            short = w[:k] + w[k + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    for alike in open_.values():
        for a in alike:
            near[a].update(b for b in alike if b != a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_checksums():
    data = np.frombuffer(b"abcdef" * 100, np.uint8)
    begin, end = np.array([0, 3, 5, 7, 0]), np.array([0, 5, 6, 77, 600])
    before = np.array([zlib.crc32(x) for x in (b"", b"1:", b"22:", b"x", b"-7:")], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(begin, end, before)]
    assert spelling.checksums(data, begin, end, before).tolist() == want


@pytest.mark.parametrize("part", [3, 1024])
def test_groups_against_brute_force(spark, part):
    """Chains of forms, ties, a block that is cut into many parts, and words with all their letters alike."""
    rng = random.Random(part)
    words = Counter()
    for _ in range(250):
        words["".join(rng.choice("abé") for _ in range(rng.randrange(3, 7)))] += rng.choice([1, 2, 30, 400])
    words.update({"chainabc": 1, "chainabd": 10, "chainabe": 10, "chainbe": 100, "chainbef": 10_000, "x" * 5000: 2, "x" * 5001: 50, "×÷ÿ": 4})
    df = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    got = collected(spelling.spelling_groups(df, part=part))
    assert got == grouped(words)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_words_of_documents(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdÉéZ") for _ in range(rng.randrange(1, 10)))
    rows = [(i, " ".join(word() for _ in range(300)) + rng.choice(["", "1", "ı\n"])) for i in range(30)]
    rows += [(1, None), (2, ""), (None, "Letters letterS ńletters"), rows[0], (40, "y" * 300 + " " + "longword " * 400_000), (41, "Ã")]
    got = {r.word: r.n for r in spelling.word_counts(docs(rows), delete=31).collect()}
    assert got == counted(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs(rows), least=2).collect()} == counted(rows, 2, 0)
    assert spelling.spelling_groups(spelling.word_counts(docs([]))).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(spelling.word_counts(docs([])), ratio=1)


def test_op11_query(spark):
    from listwright.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = collected(QUERIES["op11_spelling_variants"](spark, folder))
    assert got == grouped({w: n for w, n in counted(rows).items() if n >= 2})
