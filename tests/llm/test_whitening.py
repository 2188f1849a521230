"""Operator 12 against exact arithmetic and a plain double-precision form."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm.whitening import deviations, pack, principal, product, refine, scaled, unpack, whiten

SCHEMA = "vec_id long, embedding array<double>, id string, x double, e array<int>"


def brute(rows, count=4):
    """Everything of the contract on the driver: integers in Python, numpy's own eigenvectors."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    far = {x: sum((n * a - s) ** 2 for a, s in zip(x, total)) for x in fit}
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = dict(zip(fit, y @ vectors[:, :count] / np.sqrt(values[:count])))
    out = {}
    for i, x in good:
        for c in range(min(count, d)):
            out.setdefault((i, c + 1), []).append((n, far[tuple(x)], white[tuple(x)][c], values[c] / values.sum()))
    return out


def check(df, rows, tolerance=1e-9):
    got, want = {}, brute(rows)
    for r in df.collect():
        assert r.identity_error <= 1e-9
        got.setdefault((r[0], r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert got.keys() == want.keys()
    signs = {}
    for key in want:
        assert sorted(g[:2] for g in got[key]) == sorted(w[:2] for w in want[key])
        for g, w in zip(sorted(got[key], key=lambda r: (r[1], abs(r[2]))), sorted(want[key], key=lambda r: (r[1], abs(r[2])))):
            assert abs(g[3] - w[3]) <= 1e-9 and abs(abs(g[2]) - abs(w[2])) < tolerance
            if abs(w[2]) > 1e-3:
                signs.setdefault(key[1], set()).add(g[2] * w[2] > 0)
    assert all(len(s) == 1 for s in signs.values())


def reflector(d, rng):
    """An orthogonal matrix of fractions."""
    v = [rng.randint(-9, 9) or 1 for _ in range(d)]
    s = sum(c * c for c in v)
    return [[Fraction(int(i == j)) - Fraction(2 * v[i] * v[j], s) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("values", [
    [8, 5, 3, 2, 1, Fraction(1, 2)],
    [4, 4 - Fraction(1, 10 ** 9), 4 - Fraction(2, 10 ** 9), 1, 1 - Fraction(1, 10 ** 6), Fraction(1, 3)],
    [4, 4 - Fraction(1, 10 ** 12), 1, 1, 1, 0],
    [1] * 6,
    [1, Fraction(1, 10 ** 5), Fraction(2, 10 ** 10), Fraction(1, 10 ** 10), 0, 0]])
def test_clustered_eigenvalues(values):
    q = reflector(6, random.Random(3))
    a = [[sum(q[i][k] * values[k] * q[j][k] for k in range(6)) for j in range(6)] for i in range(6)]
    den = math.lcm(*(x.denominator for row in a for x in row))
    got, x, trace = principal([[int(v * den) for v in row] for row in a], den)
    assert np.allclose(got, [float(v) for v in values], rtol=0, atol=2e-16 * float(sum(values)))
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15 and trace == float(sum(values))
    true = np.array([[float(v) for v in row] for row in q])
    for k, v in enumerate(values):
        same = [j for j, w in enumerate(values) if w == v]
        inside = true[:, same] @ (true[:, same].T @ x[:, k])
        gap = min([abs(float(v - w)) for w in values if w != v], default=1)
        assert np.abs(inside - x[:, k]).max() < 1e-15 + 1e-18 / gap, (k, np.abs(inside - x[:, k]).max())


def test_refinement_mends_float32():
    rng = np.random.default_rng(2)
    b = rng.standard_normal((40, 40))
    a = b @ b.T
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    e, x = refine(a, rough)
    error = np.abs(a.astype(np.longdouble) @ x - x * e).max()
    assert error < 1e-15 * np.abs(a).max() < 1e-3 * np.abs(a @ rough - rough * np.asarray(e, float)).max()


def test_exact_integers():
    rng = np.random.default_rng(4)
    for top in (100, 2 ** 20, 2 ** 40, 2 ** 62):
        x = rng.integers(-top, top, (7, 3))
        assert (unpack(pack(x.ravel(), 3), 3) == x).all()
        o = x.astype(object)
        assert (product(x) == o.T @ o).all()
        y = scaled(x, 5, [1, -2, 3])
        want = [sum((5 * v - s) ** 2 for v, s in zip(row, (1, -2, 3))) for row in x.tolist()]
        assert deviations(y) == [w if w < 2 ** 63 else None for w in want]


def test_random_rows(spark):
    rng = np.random.default_rng(9)
    mix = rng.standard_normal((5, 5)) * [3, 2, 1.5, 1, 0.5]
    rows = [(i, (rng.standard_normal(5) @ mix).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(300)] + [(3, rows[7][1]), (None, rows[8][1])]  # a hot vector, odd ids
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2004, [])]
    df = spark.createDataFrame([(i, v, "k", 1.0, [1]) for i, v in rows], SCHEMA).repartition(40)
    check(whiten(df), rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = queries.op12(spark, sf)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, rows, 1e-8)


def test_without_variance(spark):
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0], "", 0.0, None), (2, [0.5, 2.0], "", 0.0, None)], SCHEMA)).collect()
    assert sorted(r[:6] for r in one) == [(i, c, 1, 0, None, 0.0) for i in (1, 2) for c in (1, 2)]
    assert {r.identity_error for r in one} == {None}
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0, 1.0], "", 0.0, None) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and {r.component for r in line} == {1, 2, 3, 4}


def test_far_values(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    got = whiten(spark.createDataFrame([(*r, "", 0.0, None) for r in rows], SCHEMA)).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got)


def test_empty(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, "", 0.0, None)], SCHEMA)).count() == 0
