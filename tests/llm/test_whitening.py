import math
import random
from fractions import Fraction

import numpy as np
import pytest

from cairnfield.llm import exact_eigen as xe
from cairnfield.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=32):
    """vec_id -> list of (deviation, whitened, explained) by numpy, from centred exact integers."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = x * n - s
    values, vectors = np.linalg.eigh((c.T @ c / n**3).astype(float))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    use = values > 1e-9
    z = (c.astype(float) / n) @ vectors[:, use] / np.sqrt(values[use])
    return n, {i: (int(dev), zi) for (i, _), dev, zi in zip(good, (c * c).sum(axis=1), z)}, values[use] / np.trace((c.T @ c / n**3).astype(float))


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.linspace(0.2, 2, d)
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def test_matches_numpy(spark):
    rows = vectors(300, 12)
    bad = [(1000, None), (1001, []), (1002, [None] + [1.0] * 11), (1003, [float("nan")] + [1.0] * 11), (1004, [float("inf")] * 12), (1005, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad + [(7, rows[7][1])]], SCHEMA).repartition(5)
    n, want, explained = brute(rows + [(7, rows[7][1])])
    got = whitening.whitened(df, components=5).collect()
    assert len(got) == 301 * 5
    signs = {}
    for r in got:
        dev, z = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        assert r.identity_error < 1e-9
        w = z[r.component - 1]
        assert abs(abs(r.whitened) - abs(w)) < 1e-8
        if abs(w) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(w * r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_low_rank_and_repeated_rows(spark):
    rows = [(i, [float(i % 3), float(i % 3), 1.0, float(i % 2)]) for i in range(60)] + [(None, [0.0, 0.0, 1.0, 0.0])] * 40
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = whitening.whitened(df).collect()
    assert {r.component for r in got} == {1, 2}
    assert len(got) == 200 and {r.n for r in got} == {100}
    assert max(r.identity_error for r in got) < 1e-9
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_clashing_columns_and_too_large_entries(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, 2, 3) for i in range(20)], "vec_id long, embedding array<double>, x int, id int, deviation int")
    assert whitening.whitened(df).count() == 40
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e300], 0), (2, [1.0], 0)], "vec_id long, embedding array<double>, label int"))


def symmetric(values, seed):
    """An integer matrix with these (rational) eigenvalues times a square: Q diag Q' for an integer Q with orthogonal rows."""
    d = len(values)
    rng = random.Random(seed)
    u = [rng.randint(-3, 3) or 1 for _ in range(d)]
    q = sum(x * x for x in u)
    h = [[(q if i == j else 0) - 2 * u[i] * u[j] for j in range(d)] for i in range(d)]  # q times a reflection
    return [[sum(h[i][k] * values[k] * h[j][k] for k in range(d)) for j in range(d)] for i in range(d)], q * q


def solve(matrix, most=99):
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    primes = xe.enough_primes(trace, len(matrix))
    poly = xe.remainders_joined(primes, xe.polynomials_mod(matrix, primes).tolist())
    return poly, xe.largest_roots(poly, most, trace)


def test_repeated_zero_and_close_roots():
    values = [0, 0, 5, 5, 5, 7, 10**12, 10**12 + 1, 10**12 + 1]
    matrix, q = symmetric(values, 1)
    _, roots = solve(matrix)
    got = [(round(r / q), c) for r, c in roots]
    assert got == [(10**12 + 1, 2), (10**12, 1), (7, 1), (5, 3)]
    for r, c in roots:
        assert abs(r / q - round(r / q)) < Fraction(1, 10**12)
        vs = xe.null_space(matrix, r, c)
        for i, v in enumerate(vs):
            exact = [sum(Fraction(a) * Fraction(x) for a, x in zip(row, v)) - r * Fraction(v[k]) for k, row in enumerate(matrix)]
            assert max(abs(float(e)) for e in exact) < 1e-11 * float(max(r, q * 10**12))
            assert all(abs(sum(x * y for x, y in zip(v, w)) - (i == j)) < 1e-12 for j, w in enumerate(vs))
    assert [c for _, c in solve(matrix, 2)[1]] == [2]


def test_polynomial_is_exact():
    for seed, d in ((1, 1), (2, 2), (3, 5), (4, 8)):
        rng = random.Random(seed)
        y = [[rng.randint(-9, 9) * (i % 3 > 0) for i in range(d)] for _ in range(6)]
        m = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
        # Faddeev and LeVerrier, with fractions
        c, cur = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
        for k in range(1, d + 1):
            cur = [[sum(m[i][t] * cur[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            c.append(-sum(m[i][t] * cur[t][i] for i in range(d) for t in range(d)) / k)
        if sum(m[i][i] for i in range(d)):
            assert solve(m)[0] == [int(x) for x in reversed(c)]


def test_model_on_given_embeddings(spark, sf_dir):
    rows = whitening.query(spark, sf_dir).collect()
    assert {r.component for r in rows} == set(range(1, 33))
    assert max(r.identity_error for r in rows) < 1e-9
    e = {r.component: r.explained for r in rows}
    assert all(e[i] >= e[i + 1] for i in range(1, 32))
