from fractions import Fraction

import numpy as np
import pytest

from listwright.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, size int"


def brute(rows, components=16):
    """Whole numbers and exact fractions for the covariance; numpy only for its eigenvectors."""
    live = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in live})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    trace = float(sum(cov[k][k] for k in range(d)))
    order = [k for k in np.argsort(-values) if values[k] > 1e-13 * trace][:components]
    out = []
    for i, x in live:
        away = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)])
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(d))
        out += [(i, c, n, deviation, abs(away @ vectors[:, k]) / np.sqrt(values[k]), values[k] / trace) for c, k in enumerate(order, 1)]
    return out


def compare(got, want):
    got = sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.component, abs(r.whitened)))
    want = sorted(want, key=lambda r: (r[0] is None, r[0], r[1], r[4]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    assert np.allclose([abs(r.whitened) for r in got], [w[4] for w in want], rtol=1e-7, atol=1e-7)
    assert np.allclose([r.explained for r in got], [w[5] for w in want], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(3)


def test_whitening_against_exact_fractions(vectors):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix + 3).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [rows[7], (None, rows[8][1])]  # copies count once
    rows += [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [float("inf")] * 6)]
    df = vectors(rows)
    got = whitening.whitened(df, whitening.fit(df)).collect()
    compare(got, brute(rows))
    signs = {(r.vec_id, r.component, round(r.whitened, 9)) for r in got if r.vec_id in (7, 200, 259)}
    assert len(signs) == 3 * 6
    few = whitening.whitened(df, whitening.fit(df, components=2)).collect()
    assert {r.component for r in few} == {1, 2}


def test_wide_values_stay_exact(vectors):
    """A large common part, and values whose squares do not fit a double."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (rng.normal(size=3) * [1, 1e5, 1e8] + [1e6, 0, 1e9])]) for i in range(40)]
    df = vectors(rows)
    compare(whitening.whitened(df, whitening.fit(df)).collect(), [(*w[:3], w[3] if w[3] < 2**63 else None, *w[4:]) for w in brute(rows)])
    with pytest.raises(Exception, match="a vector holds"):
        whitening.fit(vectors([(1, [1e30])]))


def test_squares_by_both_ways():
    values = np.random.default_rng(3).integers(-50, 50, (70, 5))
    want = [[int((values[:, i] ** 2).sum()), *[int(((values[:, i] + values[:, k]) ** 2).sum()) for k in range(i + 1, 5)]] for i in range(5)]
    assert whitening.squares(values) == want
    big = values * (1 << 30)
    assert whitening.squares(big) == [[v << 60 for v in row] for row in want]


def test_little_to_whiten(vectors):
    """Nothing, one vector, copies of one, a constant dimension, and vectors of two lengths."""
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = vectors(rows)
        assert whitening.whitened(df, whitening.fit(df)).count() == 0
    flat = [(i, [float(i), 5.0]) for i in range(9)]
    other = [(100 + i, [float(i * i), float(i), 1.0 / (i + 1)]) for i in range(9)]
    df = vectors(flat + other)
    got = whitening.whitened(df, whitening.fit(df)).collect()
    compare([r for r in got if r.vec_id < 100], brute(flat))
    compare([r for r in got if r.vec_id >= 100], brute(other))


def test_op13_query(spark):
    from listwright.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(QUERIES["op13_embedding_whitening"](spark, folder).collect(), brute(rows))
