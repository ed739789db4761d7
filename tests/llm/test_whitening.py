import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sparkaudit.llm import whitening as W


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, label string, n int")


def check(rows, out, most=16):
    """Every stated property against plain whole numbers and fractions."""
    fine = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    matrix = np.array([[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)])
    values = np.sort(np.linalg.eigvalsh(matrix.astype(float)))[::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(most, rank)
    assert len(out) == len(fine) * k
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for i, x in fine:
        for c in range(1, k + 1):
            r = by[i][c][0]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s))
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
            assert r.identity_error < 1e-6
    first = {tuple(x): i for i, x in fine}
    w = np.array([[by[first[x]][c][0].whitened for c in range(1, k + 1)] for x in fit])
    assert np.abs(w.mean(0)).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6


def test_random_vectors_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(7)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # a hot vector counts once
    rows += [(200, None), (201, []), (202, [1.0, None] + [0.0] * 5), (203, [math.nan] * 7), (204, [math.inf] + [0.0] * 6)]
    out = W.whiten(table(spark, rows)).collect()
    check(rows, out)
    other = W.whiten(table(spark, [*rows, (300, [1.0] * 3)])).collect()  # of another length
    assert {r.vec_id for r in other} == {r.vec_id for r in out}


def test_repeated_and_zero_roots(spark):
    """A cross-shaped table has equal variances in all directions; a constant dimension has none."""
    rows = [(2 * j + (s > 0), [float(s * (j == k)) for k in range(4)] + [5.0]) for j in range(4) for s in (-1, 1)]
    check(rows, W.whiten(table(spark, rows)).collect())
    line = [(i, [float(i), 2.0 * i, -3.0 * i]) for i in range(9)]
    check(line, W.whiten(table(spark, line)).collect())


def test_nothing_to_fit(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, None)])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_wide_deviation(spark):
    rows = [(1, [3e15, 1.0]), (2, [-3e15, 0.5]), (3, [1.0, 7.0])]
    out = {(r.vec_id, r.component): r for r in W.whiten(table(spark, rows)).collect()}
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    s = [sum(v[j] for v in x.values()) for j in range(2)]
    for (i, _), r in out.items():
        want = sum((3 * a - b) ** 2 for a, b in zip(x[i], s))
        assert (r.deviation, r.deviation_wide) == ((want, None) if want < 1 << 63 else (None, want))
    assert {r.deviation is None for r in out.values()} == {True, False}


def test_polynomial_and_close_roots(spark):
    rng = random.Random(4)
    a = np.array([[rng.randrange(-50, 50) for _ in range(6)] for _ in range(9)], object)
    m = a.T @ a
    poly = W.characteristic(spark, m)
    assert all(sum(c * x**k for k, c in enumerate(poly)) == det(m, x) for x in (0, 1, -3, 10))
    # two roots that doubles cannot tell apart
    big = 10**20
    roots = [big + 1, big, 7, 0]
    poly = [1]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    got = W.largest_roots(poly, 16)
    assert [(Fraction(num, 1 << bits).__round__(), times) for num, bits, times in got] == [(big + 1, 1), (big, 1), (7, 1)]
    v = W.null_space(np.diag(np.array(roots, object)), *got[1])
    assert [abs(float(e)) for e in v[0]] == pytest.approx([0, 1, 0, 0], abs=1e-15)


def det(m, x):
    """det(x I - m) by fractions."""
    a = [[Fraction(int(x * (i == j) - m[i, j])) for j in range(len(m))] for i in range(len(m))]
    out = Fraction(1)
    for k in range(len(a)):
        p = next((i for i in range(k, len(a)) if a[i][k]), None)
        if p is None:
            return 0
        if p != k:
            a[k], a[p], out = a[p], a[k], -out
        out *= a[k][k]
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            a[i] = [u - f * v for u, v in zip(a[i], a[k])]
    return int(out)
