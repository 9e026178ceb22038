import hashlib
import random
import re
from collections import Counter

import pytest

from listwright.llm import exact_dedup, substring_dedup


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_against_brute_force(docs):
    random.seed(1)
    hot = [(i, "same  text\n") for i in range(100, 160)]
    rows = hot + [(i, f"t{random.randrange(40)} \t x") for i in range(90)] + [
        (7, "same text\n"), (200, None), (201, ""), (202, "x" * 3_000_000), (203, "x" * 3_000_000), (204, " "), (204, " "), (None, "t1 x"), (None, "alone"),
    ]
    got = exact_dedup.exact_groups(docs(rows), counters=3).collect()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size, least = Counter(normal), {}
    for (i, _), t in zip(rows, normal):
        least[t] = min((x for x in (least.get(t), i) if x is not None), default=None)
    want = Counter((i, least[t], size[t], i == least[t], digest(t)) for (i, _), t in zip(rows, normal))
    assert Counter(tuple(r) for r in got) == want


def test_misra_gries_keeps_frequent_items():
    items = ["a"] * 60 + ["b"] * 30 + [str(i) for i in range(100)]
    random.seed(2)
    random.shuffle(items)
    found = exact_dedup.misra_gries(iter([items[i : i + 7] for i in range(0, len(items), 7)]), 4)
    assert len(found) <= 4 and 60 - 190 / 5 <= found["a"] <= 60


def brute(rows, window=13):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, tokens):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, tokens):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_against_brute_force(docs, seed):
    random.seed(seed)
    word = lambda n: [random.choice("abcdef") + random.choice("xy") * random.randrange(3) for _ in range(n)]
    passages = [word(random.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in random.sample(range(1000), 60):
        text = word(random.randrange(30))
        for _ in range(random.randrange(4)):
            text += random.choice(passages)[random.randrange(5) :] + word(random.randrange(6))
        rows.append((i, random.choice([" ", "\n", "\t "]).join(text)))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, rows[0][1]), rows[3], (5003, "q " * 40), (5004, "q " * 25)]
    rows += [(6000 + i, " ".join(passages[0])) for i in range(300)]  # a large group of copies
    got = substring_dedup.kept_words(docs(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))


def test_text_without_repeats_keeps_its_white_space(docs):
    passage = " ".join(f"w{i}" for i in range(15))
    out = substring_dedup.without_repeats(docs([(1, passage), (2, f"a\n\n{passage}  b\tc"), (3, None), (4, " x\n")]))
    assert out.columns == ["doc_id", "text", "mark", "row", "n_chars", "spans"]
    got = {r.doc_id: (r.text, r.n_chars, r.mark, r.spans) for r in out.collect()}
    assert got == {1: (passage, len(passage), "x", [1]), 2: ("a\n\nb\tc", 6, "x", [1]), 3: (None, None, "x", [1]), 4: (" x\n", 3, "x", [1])}


def test_empty_tables(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert substring_dedup.kept_words(docs([])).count() == 0
    assert substring_dedup.without_repeats(docs([])).count() == 0
