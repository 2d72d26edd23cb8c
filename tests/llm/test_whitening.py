"""Whitening against numpy; characteristic polynomials against definitions."""

from fractions import Fraction

import numpy as np
import pytest

from codecorpus.llm import charpoly as C
from codecorpus.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.linspace(0.3, 2, d)
    return [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]


def brute(rows, d, top):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and np.isfinite(v) for v in r[1])]
    y = np.floor(64 * np.array([r[1] for r in kept], float))
    n = len(y)
    e, u = np.linalg.eigh(np.cov(y.T, bias=True))
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    total = [int(s) for s in y.sum(0)]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in y]
    return kept, n, (y - y.mean(0)) @ u / np.sqrt(e), e / np.cov(y.T, bias=True).trace(), deviations


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_against_numpy(spark):
    rows = vectors(300, 12)
    odd = [(900, None, 0), (901, [float("nan")] * 12, 0), (902, [None] + [0.0] * 11, 0), (903, [float("inf")] + [0.0] * 11, 0),
           (904, [], 0), (905, [1.0, 2.0], 0), (None, rows[5][1], 1), (7, rows[7][1], 2), (7, rows[7][1], 2)]
    got = W.whiten(table(spark, rows + odd).withColumnsRenamed({"label": "component"}).repartition(5), top=5).toPandas()
    kept, n, want, share, deviations = brute(rows + odd, 12, 5)
    assert len(got) == 5 * n and set(got.n) == {n} and set(got.component) == {1, 2, 3, 4, 5}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    wide = got.groupby(["vec_id", "component"], dropna=False)[["whitened", "deviation", "explained"]].agg(["min", "max"])
    assert np.allclose(wide["whitened"]["min"], wide["whitened"]["max"], atol=1e-14)
    first = {}  # of repeated rows one
    for i, r in enumerate(kept):
        first.setdefault(10 ** 6 if r[0] is None else r[0], i)
    key = [first[v] for v in sorted(first)]
    assert [int(v) for v in wide["deviation"]["min"].to_numpy()[::5]] == [deviations[i] for i in key]
    values = wide["whitened"]["min"].to_numpy().reshape(len(key), 5)
    signs = np.sign((values * want[key]).sum(0))
    assert np.abs(values * signs - want[key]).max() < 1e-10
    assert np.allclose(wide["explained"]["min"].to_numpy()[:5], share, rtol=1e-12)


def test_repeated_eigenvalues(spark):
    """Axes of equal spread: any orthonormal basis whitens them."""
    rows = [(k, [float(s * (j == k // 2)) for j in range(6)], 0) for k in range(12) for s in [1 - 2 * (k % 2)]]
    got = W.whiten(table(spark, rows)).toPandas()
    assert set(got.component) == {1, 2, 3, 4, 5, 6} and got.identity_error[0] < 1e-12
    assert np.allclose(got.explained, 1 / 6)


def test_rank_below_dimension(spark):
    """Components without spread have no rows."""
    rows = [(i, [float(i), 2.0 * i, 5.0, float(i % 3)], 0) for i in range(9)]
    got = W.whiten(table(spark, rows)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error[0] < 1e-12


def test_large_entries(spark):
    rows = [(i, [1e14 * ((i * 7) % 5), 3e12 * i, 1.0], 0) for i in range(8)]
    got = W.whiten(table(spark, rows)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error[0] < 1e-9 and got.deviation.isna().any()


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [0.5, 0.25], 0) for i in range(4)]])
def test_without_spread(spark, rows):
    assert W.whiten(table(spark, rows)).isEmpty()


def test_polynomial_has_the_definition_s_value():
    m = np.random.default_rng(3).integers(-9, 10, (7, 7))
    m = (m @ m.T).astype(object)
    qs = C.primes(4)
    p = C.remaindered([C.modular(m, q).tolist() for q in qs], qs)

    def det(a):
        return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([r[:j] + r[j + 1:] for r in a[1:]]) for j in range(len(a)))

    for x in (-3, 0, 5, 1000):
        assert sum(c * x ** k for k, c in enumerate(p)) == det([[x * (i == j) - m[i, j] for j in range(7)] for i in range(7)])


def test_roots_that_doubles_cannot_tell_apart():
    """Roots 10**12, that plus one (twice) and zero."""
    a = 10 ** 12
    p = [1]
    for r in (a, a + 1, a + 1, 0):
        p = [x - r * y for x, y in zip([0, *p], [*p, 0])]
    layers = C.layers(p, C.primes(8))
    assert [len(q) - 1 for q in layers] == [3, 1]
    roots = [C.narrowed(layers[0], lo, hi, Fraction(1, 8)) for lo, hi in C.top_roots(layers[0], 9, 4 * a)]
    assert [round(lo) for lo, _ in roots] == [a + 1, a, 0]
    m = np.diag([a, a + 1, 0, a + 1]).astype(object)
    two = np.array(C.null_vectors(m, Fraction(a + 1), Fraction(1), 2))
    assert np.allclose(two[:, [0, 2]], 0, atol=1e-15) and np.allclose(two @ two.T, np.eye(2), atol=1e-15)
