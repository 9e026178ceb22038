import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from listwright.llm import embedding_dedup, line_dedup, near_dedup
from listwright.llm.components import components, linked_groups
from listwright.sources.storage import free


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    random.seed(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 400)]
    links = chain + star + [(1, 2), (2, 3), (3, 1), (5, 5), (160, 399), (None, 9)]
    random.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups_of({x for link in real for x in link}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_link_within_a_bucket_is_lost(spark):
    """Also where the members linked with each other are not linked with the least of the bucket."""
    linked = {(1, 4), (2, 3), (3, 6), (4, 5)}
    members = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 9), (3, 1), (3, 9)], "bucket bigint, id bigint")
    rows = spark.createDataFrame(sorted(linked), "a bigint, b bigint")
    got = {r.node: r.component for r in linked_groups(members, lambda p: p.join(rows, ["a", "b"])).collect()}
    assert got == groups_of({x for link in linked for x in link}, linked)


def changed(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = f"z{random.randrange(10**6)}"
    return " ".join(words)


def test_near_documents_against_brute_force(docs):
    random.seed(5)
    base = [" ".join(f"w{random.randrange(500)}" for _ in range(random.randrange(60, 300))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, changed(t, 1 + i % 3)) for i, t in enumerate(base)]
    rows += [(200 + i, changed(base[0], 1)) for i in range(60)]  # a large group of near copies
    rows += [(300, base[3]), (301, base[3].replace(" ", "\n")), (302, None), (303, ""), (304, " "), (305, "a b"), (306, "a b"), (307, "a"), (None, base[1]), (3, base[3])]
    table = docs(rows)
    got = near_dedup.near_groups(table).collect()
    sampler = near_dedup.fit_weights(table)
    weights = plain_weights([t for _, t in rows])
    real = [(i, t or "") for i, t in rows if i is not None]
    pairs = [(a, b) for k, a in enumerate(real) for b in real[:k]]
    alike = near_dedup.similarities(sampler, pa.array([a[1] for a, _ in pairs]), pa.array([b[1] for _, b in pairs]))
    # The similarities themselves, weights and all, computed plainly.
    times = {t: Counter(word_runs(t)) for _, t in real}
    for (a, b), found in zip(pairs, alike):
        assert abs(found - plain_similarity(weights, times[a[1]], times[b[1]])) < 1e-5
    want = groups_of([i for i, _ in real], [(a[0], b[0]) for (a, b), s in zip(pairs, alike) if s >= 0.8])
    found = {(r.doc_id, r.component_id, r.kept) for r in got}
    assert found == {(i, want[i], want[i] == i) for i, _ in real} | {(None, None, True)}
    assert len(got) == len(rows)
    assert near_dedup.near_groups(docs([])).count() == 0


def test_weights_are_of_the_shares_of_documents(docs):
    """Also with more shingles than any table of buckets holds apart, and alike in a corpus of any size."""
    texts = [" ".join(f"d{i}w{k}" for k in range(400)) + (" one two three four five" if i % 3 == 0 else "") for i in range(900)]
    sampler = near_dedup.fit_weights(docs(list(enumerate(texts))))
    for text, n in (("d5w1 d5w2 d5w3 d5w4 d5w5 d5w6 d5w7", 1), ("one two three four five", 300)):
        weight = sampler.weighted(*near_dedup.text_column(pa.array([text])))[2]
        assert np.allclose(weight, 1 + np.log(900 / n) / np.log(1000), atol=1e-5)
    some = [" ".join(f"d{i % 5}w{k}" for k in range(i, i + 40)) for i in range(20)]
    column = pa.array(some)
    one, many = (near_dedup.fit_weights(docs(list(enumerate(some * times)))) for times in (1, 60))
    assert np.allclose(*(s.weighted(*near_dedup.text_column(column))[2] for s in (one, many)))


def test_documents_at_the_threshold_are_found(docs):
    """Pairs of documents at a similarity of 0.803, and pairs at 0.797, of which none is a link."""
    rows = []
    for i in range(1600):
        text = " ".join(f"p{i}w{k}" for k in range(204))
        rows += [(2 * i, text), (2 * i + 1, text + "".join(f" q{i}w{k}" for k in range(49 if i < 1500 else 51)))]
    gone = [r.doc_id for r in near_dedup.near_groups(docs(rows)).where("NOT kept").collect()]
    assert all(i % 2 for i in gone) and max(gone) < 3000
    assert len(gone) >= 0.99 * 1500


def word_runs(text):
    words = text.split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain_weights(texts):
    counts = Counter(run for text in texts for run in set(word_runs(text or "")))
    return {run: 1 + min(1, np.log(len(texts) / n) / np.log(1000)) for run, n in counts.items()}


def plain_similarity(weights, x, y):
    most = sum(weights[k] * max(x[k], y[k]) for k in x.keys() | y.keys())
    return sum(weights[k] * min(x[k], y[k]) for k in x.keys() & y.keys()) / most if most else 0.0


def runs(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def line_brute(rows):
    lines = sorted((i is None, i, k, t.strip(" \t\x0b\x0c\r")) for i, text in rows for k, t in enumerate((text or "").split("\n")) if t.strip(" \t\x0b\x0c\r"))
    first = {}
    for none, i, k, t in lines:
        first.setdefault(t, (none, i, k))
    names = list(first)
    sets = [runs(t) for t in names]
    links = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = groups_of(range(len(names)), links)
    least = {}
    for k, t in enumerate(names):
        least[group[k]] = min(least.get(group[k], first[t]), first[t], key=lambda p: (p[0], p[1] or 0, p[2]))
    number = {t: k for k, t in enumerate(names)}
    return Counter((i, k, *least[group[number[t]]][1:], least[group[number[t]]][1:] == (i, k)) for _, i, k, t in lines)


def test_lines_against_brute_force(docs):
    random.seed(6)
    letters = "abcdefghij klmnop"
    make = lambda n: "".join(random.choice(letters) for _ in range(n)).strip() or "x"
    base = [make(random.choice([3, 9, 40, 120, 400])) for _ in range(30)]
    edit = lambda s: s[:20] + random.choice(letters) + s[20:]
    rows = []
    for i in range(60):
        some = [random.choice(base) for _ in range(4)] + [edit(random.choice(base)), make(50), "", "  "]
        random.shuffle(some)
        rows.append((i, "\n".join(f" {s}\t" for s in some)))
    rows += [(100, None), (101, ""), (102, "😀é" * 30 + "\r\nab"), (103, "\n\n"), (104, "y" * 200_000), (105, "y" * 200_000 + "z")]
    got = Counter((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.line_groups(docs(rows)).collect())
    assert got == line_brute(rows)


def test_lines_at_the_threshold_are_found(docs):
    """Lines of 20 to 60 runs, and long ones, and their like at a similarity of 0.8, the least that links."""
    rng = random.Random(12)
    make = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    rows = []
    for i in range(2200):
        n = rng.randrange(20, 61, 4) if i < 2000 else 2000
        line = make(n + 4)
        rows += [(2 * i, line), (2 * i + 1, line + make(n // 4))]
    got = line_dedup.line_groups(docs(rows)).where("NOT kept").collect()
    assert all(r.first_doc_id == r.doc_id - 1 for r in got)
    assert sum(r.doc_id < 4000 for r in got) > 0.985 * 2000 and sum(r.doc_id >= 4000 for r in got) >= 196


def test_lines_with_changed_characters_are_found(docs):
    """One changed character from 49 on, two from 94 on; fewer leave a similarity below 0.8, also where a
    length passes from one side of 160 to the other."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789   "
    rows, pairs = [], 0
    for edits, least in ((1, 49), (2, 94), (3, 159)):
        for _ in range(300):
            line = ["q", *(rng.choice(letters) for _ in range(rng.randrange(least, least + 60) - 2)), "q"]
            other = list(line)
            for at in rng.sample(range(4, len(line) - 4), edits):
                other[at] = "#"
            rows += [(2 * pairs, "".join(line)), (2 * pairs + 1, "".join(other))]
            pairs += 1
    want = sum(len(runs(a) & runs(b)) >= 0.8 * len(runs(a) | runs(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    gone = line_dedup.line_groups(docs(rows)).where("NOT kept").collect()
    assert all(r.first_doc_id == r.doc_id - 1 for r in gone)
    assert 0.99 * want < len(gone) <= want and want > 0.95 * pairs


def test_a_bucket_of_lines_below_the_threshold(docs):
    """Many variants of one line, of which some reach the threshold: blocks against all pairs."""
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefghij klm") for _ in range(200)).strip()
    rows = []
    for i in range(150):
        other = list(line)
        for at in rng.sample(range(len(line)), rng.choice([2, 5, 9])):
            other[at] = rng.choice("xyz")
        rows.append((i, "".join(other)))
    got = Counter((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.line_groups(docs(rows)).collect())
    assert got == line_brute(rows)
    own = np.arange(150) % 7
    column = pa.array([t for _, t in rows])
    i, j = line_dedup.linked_pairs(column, own, None, 5, 0.8)
    sets = [runs(t) for _, t in rows]
    want = {(a, b) for b in range(150) for a in range(b) if own[a] != own[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert set(zip(i.tolist(), j.tolist())) == want
    some = sorted(want)[:50]
    alike = line_dedup.similarities(column.take(pa.array([a for a, _ in some])), column.take(pa.array([b for _, b in some])))
    assert np.allclose(alike, [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in some])


def test_documents_without_repeated_lines(docs):
    line = "the quick brown fox jumps over the lazy dog and runs away from it all day long without a pause"
    rows = [(2, f"{line}!\nnew\n\nnew"), (1, f"a\n{line}"), (3, None), (4, " keep \n"), (None, "a")]
    out = line_dedup.without_repeats(docs(rows))
    assert out.columns == ["doc_id", "text", "mark", "row", "n_chars", "spans"]
    got = {r.doc_id: (r.text, r.n_chars, r.mark) for r in out.collect()}
    assert got == {1: (rows[1][1], len(rows[1][1]), "x"), 2: ("new\n", 4, "x"), 3: (None, None, "x"), 4: (" keep \n", 7, "x"), None: ("", 0, "x")}
    assert line_dedup.line_groups(docs([])).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    near = np.repeat(centres[:20], 6, axis=0) + rng.normal(size=(120, 16)) * 0.12
    hot = centres[30] + rng.normal(size=(300, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([centres, near, hot]))]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [None, *[1.0] * 15]), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9007, [2.0, 4.0]), (9006, None), (9006, [5.0, 1.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, label int, cell string")
    every = embedding_dedup.vector_groups(table, block=64).collect()
    got = {r.vec_id: r for r in every}
    assert len(got) == len(every)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()
    count = Counter(x for link in linked for x in link)
    found = sum(got[i].n_links for i, _ in rows) / 2
    assert all(got[i].n_links <= count[i] for i, _ in rows)
    assert found >= 0.95 * len(linked)
    want = groups_of([i for i, _ in rows], linked)
    assert sum(got[i].component_id == want[i] for i, _ in rows) >= 0.97 * len(rows)
    assert all((r.vec_id == r.component_id) == r.kept for r in got.values() if r.vec_id is not None)
    for i in range(9000, 9006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[9006].n_links, got[9007].component_id) == (1, 9006)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert embedding_dedup.vector_groups(table.limit(0)).count() == 0


def shuffles(spark):
    """Shuffles that have files on this machine's disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_rounds_leave_no_shuffles_behind(spark):
    """A long chain takes many rounds, of which none keeps its files until the driver happens to collect garbage."""
    before = shuffles(spark)
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a bigint, b bigint")
    got = components(links)
    assert got.where("component = 0").count() == 3001
    least = len(shuffles(spark) - before)
    for _ in range(20):  # files are removed by a thread of the driver
        if least <= 12:
            break
        time.sleep(0.25)
        least = min(least, len(shuffles(spark) - before))
    assert least <= 12


def test_lines_run_in_the_engine_alone(docs):
    """No Python worker takes part in finding lines that repeat, here also with a link and a hot bucket."""
    line = "the quick brown fox jumps over the lazy dog and runs away from it all day long without a pause"
    rows = [(i, f"{line} {i % 7}\nshort\nother {i}") for i in range(60)]
    text = docs(rows)
    ran, real = [], type(text).mapInArrow
    try:
        type(text).mapInArrow = lambda self, *a, **b: ran.append(1) or real(self, *a, **b)
        groups = line_dedup.line_groups(text)
        gone = groups.where("NOT kept").collect()
    finally:
        type(text).mapInArrow = real
    assert not ran and "Python" not in (plan := groups._jdf.queryExecution().toString()) and "MapInArrow" not in plan
    assert sum(r.line_no == 0 for r in gone) == 59 and sum(r.line_no == 1 for r in gone) == 59


def test_repeats_of_rows_without_an_id(docs):
    """A row without an id comes last, and its lines point to themselves where no other line is like them."""
    got = Counter(tuple(r) for r in line_dedup.line_groups(docs([(None, "alone here\nshared line"), (3, "shared line")])).drop("text_hash").collect())
    assert got == Counter([(None, 0, None, 0, True), (None, 1, 3, 0, False), (3, 0, 3, 0, True)])


def test_no_pair_is_compared_twice(spark):
    """Unlike members of small buckets meet the least one first, and all others at the end."""
    members = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 3), (2, 9), (3, 3), (3, 9), (4, 0), (4, 5)], "bucket bigint, id bigint")
    linked = spark.createDataFrame([(2, 4)], "a bigint, b bigint")
    asked = []

    def verify(pairs):
        asked.extend(map(tuple, pairs.collect()))
        return pairs.join(linked, ["a", "b"])

    assert {r.node: r.component for r in linked_groups(members, verify).collect()} == {2: 2, 4: 2}
    assert sorted(asked) == sorted([(a, b) for a in range(6) for b in range(a + 1, 6)] + [(3, 9)])


def test_runs_are_cut_once(docs, monkeypatch):
    made = []
    monkeypatch.setattr(line_dedup, "cut", lambda df: made.append(df) or df)
    line_dedup._signatures(docs([]).selectExpr("doc_id AS id", "text AS line"), 5)
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]


def test_hashed_runs_are_those_of_code_points(spark):
    texts = ["abcdeabcdef", "äöü€😀xyz", "abcd", "", "aaaaaaaa", "a\nb\tc d"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", line_dedup._hashed_runs("text", 5).alias("got"), F.transform(line_dedup._runs_of("text", 5), lambda x: F.xxhash64(F.encode(x, "UTF-32"))).alias("want")
    )
    for row in rows.collect():
        assert row.got == row.want and len(row.got) == max(0, len(row.text) - 4)


def test_files_are_let_go_at_once(spark, tmp_path):
    free(spark)
    time.sleep(1)
    for k in range(3):
        before = shuffles(spark)
        found = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.min("id").alias("first"))
        found.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/{k}")
        new = shuffles(spark) - before
        assert new
        del found
        free(spark)
        time.sleep(1)
        assert not new & shuffles(spark)
