"""Exact whitening against numpy and against fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strandframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n string, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def whole(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def check(got, vectors, ids=None):
    x = whole(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in zip(ids or range(n), x, strict=True)}
    # the covariance in fractions, then as doubles
    cov = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(8, d)
    assert len(got) == n * k
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    centred = np.array(x, float) - np.array(sums) / n
    by = {}
    for r in got:
        assert r.deviation == exact[r.vec_id] == r.deviation_wide
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
        by.setdefault(r.component, {})[r.vec_id] = r.whitened
    for c, found in by.items():
        w = np.array([found[i] for i in (ids or range(n))], float)
        exp = centred @ vectors_[:, c - 1] / np.sqrt(values[c - 1])
        yield c, w, exp, cov


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32).tolist()
    got = whitening.op11_query(frame(spark, vectors)).collect()
    for _, w, exp, _ in check(got, vectors):
        assert min(np.abs(w - exp).max(), np.abs(w + exp).max()) < 1e-7
    assert got[0].identity_error < 1e-9


def test_odd_rows(spark):
    """Nulls, non-finite entries, other lengths and entries beyond a long are left out; repeated and nameless rows count."""
    rng = np.random.default_rng(2)
    good = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(i, v, None, None, None, None) for i, v in enumerate(good)] + [(0, good[0], 1, None, None, None)]
    odd = [None, [], [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [0.0, 0.0, -math.inf], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1e30, 0.0, 0.0]]
    rows += [(100 + i, v, None, None, None, None) for i, v in enumerate(odd)] + [(None, [0.5, 0.25, 0.125], None, None, None, None)]
    got = whitening.op11_query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {42}
    assert {r.vec_id for r in got} == {*range(40), None}
    x = whole([*good, good[0], [0.5, 0.25, 0.125]])
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.deviation for r in got if r.vec_id == 7} == {sum((42 * c - s) ** 2 for c, s in zip(x[7], sums, strict=True))}
    assert got[0].identity_error < 1e-9


def test_degenerate(spark):
    same = whitening.op11_query(frame(spark, [[0.5, 0.25]] * 5)).collect()
    assert len(same) == 10 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in same)
    line = whitening.op11_query(frame(spark, [[i / 4, i / 2, 1.0] for i in range(9)])).collect()
    first = sorted(abs(r.whitened) for r in line if r.component == 1)
    assert np.allclose(first, sorted(abs(i - 4) / math.sqrt(60 / 9) for i in range(9)))
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)
    # equal roots: any basis of their space whitens
    cross = [[s * (i == k) for i in range(4)] for k in range(4) for s in (1.0, -1.0)]
    got = whitening.op11_query(frame(spark, cross)).collect()
    assert all(abs(r.explained - 0.25) < 1e-12 for r in got) and got[0].identity_error < 1e-9
    empty = whitening.op11_query(frame(spark, [[1.0]]).limit(0))
    assert empty.count() == 0 and empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Entries whose products pass 64 bits are still summed exactly."""
    rnd = random.Random(3)
    vectors = [[rnd.choice([-1, 1]) * 2.0 ** rnd.randint(0, 40), rnd.uniform(-1, 1), 2.0**30 + i * 4096] for i in range(60)]
    vectors = [[float(np.float32(c)) for c in v] for v in vectors]
    got = whitening.op11_query(frame(spark, vectors)).collect()
    x = whole(vectors)
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        dev = sum((60 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert int(r.deviation_wide) == dev if dev < 10**38 else r.deviation_wide is None
        assert r.deviation == (dev if dev < 1 << 63 else None)
    assert got[0].identity_error < 1e-4


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial(spark, d):
    rnd = random.Random(d)
    half = np.array([[rnd.randint(-(10**6), 10**6) for _ in range(d)] for _ in range(d - (d > 2))], object)
    a = half.T @ half
    # Faddeev and LeVerrier's recursion, in whole numbers
    m, c = np.zeros((d, d), object), [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        c[d - k] = -int((a @ m).trace()) // k
    assert whitening.characteristic(spark, a) == c
    roots = [float(r) for r, n in whitening.largest_roots(c, d) for _ in range(n)]
    assert np.allclose(roots, np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-9, atol=float(max(roots)) * 1e-12)


def test_roots():
    def product(roots):
        c = [1]
        for r in roots:
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c

    for roots in ([7], [5, 5, 5], [0, 0, 3], [10**20, 10**20 - 1, 4, 4, 1, 0], list(range(20))):
        found = [r for r, n in whitening.largest_roots(product(roots), 8) for _ in range(n)]
        assert all(abs(a - b) < Fraction(1, 1 << 60) for a, b in zip(found, sorted(roots, reverse=True), strict=False)) and len(found) >= min(8, len(roots))


def test_close_roots():
    """Components stay right where two roots nearly meet, which doubles would mix."""
    a = np.array([[10**15, 1, 0], [1, 10**15 + 1, 0], [0, 0, 5]], object)
    v = whitening.null_space(a.tolist(), Fraction(10**15) + Fraction(1, 2) + Fraction(math.isqrt(5 * 10**80), 2 * 10**40), 1)[0]
    ratio = (1 + math.sqrt(5)) / 2
    assert abs(v[1] / v[0] - ratio) < 1e-14 and v[2] == 0


def test_characteristic_mod():
    p = whitening.primes(3)[2]
    a = np.array([[0, 1, 2, 0], [0, 0, 3, 1], [0, 5, 0, 0], [4, 0, 0, 1]])
    got = whitening.characteristic_mod(a, p)
    for x in range(5):
        want = round(np.linalg.det(np.eye(4) * x - a)) % p
        assert sum(int(c) * x**k for k, c in enumerate(got)) % p == want
