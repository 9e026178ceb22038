"""Both ways to order siblings against a plain queue on random groups."""

import heapq
import random

import pytest

from listwright.operators import ordering


def queue_order(rows, resolve=None):
    """rows: (pos, id, after, first). Lowest position first among the available ones."""
    ids = {r[1] for r in rows}
    by_pos = sorted(rows)
    if resolve:
        targets = {r[1]: resolve(r[2]) if r[2] is not None else None for r in rows}
        referenced = {t for i, t in targets.items() if t is not None and t != i}
    else:
        targets = {r[1]: r[2] if r[2] in ids else None for r in rows}
        referenced = set()
    first = [r[1] for r in by_pos if r[3]]
    tied = [r for r in by_pos if not r[3] and (targets[r[1]] is not None or r[1] in referenced)]
    free = [r[1] for r in by_pos if not r[3] and r[1] not in {t[1] for t in tied}]
    inside = {r[1]: r[0] for r in tied}
    waiting = {i: targets[i] for i in inside if targets[i] in inside}
    ready = [(p, i) for i, p in inside.items() if i not in waiting]
    heapq.heapify(ready)
    done = []
    while ready:
        _, i = heapq.heappop(ready)
        done.append(i)
        for j in [j for j, t in waiting.items() if t == i]:
            del waiting[j]
            heapq.heappush(ready, (inside[j], j))
    return first + done + [r[1] for r in tied if r[1] in waiting] + free


def random_groups(seed, sizes):
    rng = random.Random(seed)
    groups = {}
    for g, n in enumerate(sizes):
        pos = rng.sample(range(10 * n), n)
        ids = [f"/i{k}" for k in range(n)]
        groups[g] = [
            (pos[k], ids[k], rng.choice(ids + ["/gone"]) if rng.random() < 0.7 else None, rng.random() < 0.1) for k in range(n)
        ]
    return groups


@pytest.mark.parametrize("short", [0, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_siblings(spark, seed, short):
    groups = random_groups(seed, [1, 2, 3, 5, 8, 13, 21, 40, 60])
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g int, pos long, id string, after string, first boolean")
    found = ordering.order_siblings(df, ["g"], short=short).collect()
    for g, rows in groups.items():
        got = [r["id"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["ord"])]
        assert got == queue_order(rows), g


@pytest.mark.parametrize("short", [0, 64])
def test_columns(spark, short):
    groups = random_groups(3, [1, 2, 4, 9, 25, 50])
    rng = random.Random(5)
    spelled, want = [], {}
    for g, rows in groups.items():
        def title(i):
            return "Title " + i

        written = [
            (p, i, None if a is None else rng.choice([a, a[1:], title(a)]), f) for p, i, a, f in rows
        ]
        names = {}
        for _, i, _, _ in rows:
            names.update({i: i, i[1:]: i, title(i): i})
        want[g] = queue_order(written, names.get)
        spelled += [(g, p, i, title(i), a, f) for p, i, a, f in written]
    df = spark.createDataFrame(spelled, "g int, pos long, path string, title string, after string, first boolean")
    found = ordering.order_columns(df, ["g"], short=short).collect()
    for g in groups:
        got = [r["path"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["ord"])]
        assert got == want[g], g


def test_long_chain_takes_few_rounds(spark):
    n = 300
    rows = [(1, n - k, f"i{k}", f"i{k - 1}" if k else None, False) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, pos long, id string, after string, first boolean")
    found = ordering.order_siblings(df, ["g"], short=0).orderBy("ord").collect()
    # The root has no predecessor and is free, so it closes the list.
    assert [r["id"] for r in found] == [f"i{k}" for k in range(1, n)] + ["i0"]


def test_condition_last(spark):
    rows = [(1, 0, "a", None, False, "t", "v"), (1, 1, "b", None, False, None, None), (1, 2, "c", None, True, None, None), (1, 3, "d", "a", False, "t", "v")]
    df = spark.createDataFrame(rows, "g int, pos long, id string, after string, first boolean, trigger string, value string")
    found = ordering.condition_last(df, ["g"]).orderBy("dependent", "ord").collect()
    assert [r["id"] for r in found] == ["c", "b", "d", "a"]


@pytest.mark.parametrize("short", [0, 64])
def test_ways_into_circles_come_last(spark, short):
    """Circles of one, two and three rows, ways that lead to them, and a missing value whose trigger another row has."""
    after = {"a": "a", "b": "c", "c": "b", "d": "e", "e": "f", "f": "d", "g": "d", "h": "i", "i": "j", "j": None, "k": "b", "l": "k"}
    rows = [(20 - n, i, a, False) for n, (i, a) in enumerate(after.items())]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, pos long, id string, after string, first boolean")
    found = ordering.order_siblings(df, ["g"], short=short).orderBy("ord").collect()
    assert [r["id"] for r in found] == queue_order(rows)


def test_rows_are_numbered_without_computing_them_again(spark):
    """The rows to order are computed once, however many steps read them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = "g int, pos long, id string, path string, title string, after string, first boolean"
    rows = [(g, n, f"i{n}", f"i{n}", f"t{n}", f"i{n + 1}", False) for g in range(3) for n in range(4)]
    df = spark.createDataFrame(rows, columns).mapInArrow(count, columns)
    for order in (ordering.order_siblings, ordering.order_columns):
        before = seen.value
        assert order(df.select(*[c for c in df.columns if c != ("path" if order is ordering.order_siblings else "id")]), ["g"], short=0).count() == 12
        assert seen.value - before == 12


def test_condition_last_finds_a_trigger_by_another_rows_value(spark):
    rows = [(1, 0, "a", "t", None), (1, 1, "b", "t", "v"), (1, 2, "c", "u", None), (1, 3, "d", None, "v"), (2, 0, "a", "t", None)]
    df = spark.createDataFrame(rows, "g int, pos long, id string, trigger string, value string").selectExpr(
        "*", "CAST(NULL AS STRING) AS after", "false AS first"
    )
    for short in (0, 64):
        found = ordering.condition_last(df, ["g"], short=short).collect()
        assert {(r["g"], r["id"]) for r in found if r["dependent"]} == {(1, "a"), (1, "b")}
        assert len(found) == 5
