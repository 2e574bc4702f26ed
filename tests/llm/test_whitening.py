"""Slicing of spectra against numpy, and whitened rows against sums by brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from recordloom.llm import spectrum_slicing
from recordloom.llm.spectrum_slicing import Factors, leading


def spread(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    m = (q * np.array(values, float)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1e6, 1, 1e-2, 1e-2, 0], [3, 3, 3, 3, 3, 1], [7, 7, 7 - 1e-9, 2], [2, 2, 1, 1, 0.5, 0.5], [1], [1, 0, 0], list(range(60, 0, -1)),
    [1 + 1e-6 * i for i in range(20)],
])
def test_leading_eigenvalues(values):
    matrix = spread(values)
    want = sorted((v for v in np.linalg.eigvalsh(matrix) if v > 1e-9 * max(values)), reverse=True)[:4]
    got = leading(matrix, 4)
    assert np.allclose([e for e, _ in got], want, rtol=1e-10, atol=1e-12 * max(values))
    basis = np.stack([u for _, u in got], axis=1)
    assert np.abs(basis.T @ basis - np.eye(len(got))).max() < 1e-9
    for e, u in got:
        assert np.linalg.norm(matrix @ u - e * u) < 1e-11 * max(values) * len(values)


def test_counts_of_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        for _ in range(10):
            m = rng.normal(size=(n, n))
            m = m + m.T
            np.fill_diagonal(m, 0)  # needs blocks of two
            assert Factors(m).positive() == (np.linalg.eigvalsh(m) > 0).sum()
            right = rng.normal(size=n)
            if n > 1:
                assert np.allclose(m @ Factors(m).solve(right, 0.0), right, atol=1e-7)


def brute(vectors):
    xs = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    v = np.array([[float(sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for x in xs) / n) for j in range(d)] for i in range(d)])
    return xs, n, sums, v


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [np.float32(rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1] + 4).tolist() for _ in range(80)]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, i, "x") for i, v in enumerate(data)]
    rows += [(i, data[0], 1, "x") for i in range(200, 240)] + [(0, data[0], 1, "x"), (None, data[1], 1, "x")]  # a hot vector, repeated rows
    rows += [(500, None, 1, "x"), (501, [], 1, "x"), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x"), (503, [nan] * 6, 1, "x"),
             (504, [inf] * 6, 1, "x"), (505, [1.0, 2.0], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int, block string").repartition(5)
    got = spectrum_slicing.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    xs, n, sums, v = brute(data)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [(i, x) for i, x, *_ in rows if i is None or i < 500]
    assert len(found) == 4 * len(kept) and {r.n for r in found} == {n}
    signs = {}
    by_id = {(r.vec_id, r.component): r for r in found}
    for i, vector in kept:
        x = [math.floor(256 * c) for c in vector]
        for k in range(4):
            r = by_id[i, k + 1]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = float((np.array(x) - np.array(sums) / n) @ vectors[:, k]) / math.sqrt(values[k])
            sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
            assert math.isclose(r.whitened * sign, want, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r.explained, values[k] / v.trace(), rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitening_of_few_or_equal_vectors(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert spectrum_slicing.whiten(spark.createDataFrame([], kind)).count() == 0
    assert spectrum_slicing.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    two = spectrum_slicing.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, None)], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two) == [(1, 1, 2, 256**2, 1.0, 1.0), (2, 1, 2, 256**2, 1.0, 1.0)]


def test_large_entries_are_added_exactly(spark):
    data = [(1, [3.0e9, 1.0]), (2, [-1.0e9, 2.0]), (3, [5.5e9, -7.0]), (4, [1e13, 0.0])]
    got = {r.vec_id: r for r in spectrum_slicing.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), 1).collect()}
    xs, n, sums, v = brute([x for _, x in data])
    for i, vector in data:
        want = sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(vector, sums))
        assert got[i].deviation == (want if want < 2**63 else None)
        assert math.isclose(got[i].explained, np.linalg.eigvalsh(v)[-1] / v.trace(), rel_tol=1e-12) and got[i].identity_error < 1e-9
