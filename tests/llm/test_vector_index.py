"""Operator 8 against brute force in double precision."""

import math
import random

import numpy as np

from corvane.llm import vector_index
from corvane.llm.vector_index import Grid, near_duplicates, unit


def brute(rows, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    dims = [len(v) for (_, v), g in zip(rows, good) if g]
    dim = max(set(dims), key=dims.count) if dims else 0
    good = [g and len(v) == dim for (_, v), g in zip(rows, good)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = [i for i, g in enumerate(good) if g]
    x = unit(np.array([rows[i][1] for i in at], np.float32)) if at else np.empty((0, 2))
    a, b = np.nonzero(x @ x.T >= cosine)
    for i, j in zip(a.tolist(), b.tolist()):
        if i < j:
            i, j = at[i], at[j]
            n[i] += 1
            n[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, n[i], least.get(find(i))) for i, (d, _) in enumerate(rows)}, sum(n)


def check(df, rows, recall):
    got = near_duplicates(df).collect()
    want, total = brute(rows)
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= recall * total
    assert all(r.kept == (r.id == r.component_id) for r in got)
    return {(r.id, r.n_links, r.component_id) for r in got}, want, total, sum(r.n_links for r in got)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(b + rng.gauss(0, 0.05))) for b in base[i % 5]]) for i in range(60)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (202, [2 * v for v in rows[0][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (305, [float("inf")] * 6),
             (306, [1.0, 2.0]), (None, None), (307, [-0.0] * 6), (308, [1e-30] * 6)]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, w double, e string").repartition(3)
    got, want, _, _ = check(df, rows, 1.0)
    assert got == want
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 1)
    assert check(df, rows, 1.0)[0] == want


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, want, total, found = check(df, [(r.vec_id, r.embedding) for r in df.collect()], 0.95)
    assert found <= total


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_order_is_by_growing_distance():
    rng = np.random.default_rng(0)
    x = unit(rng.standard_normal((300, 8)))
    g = Grid(x, 7, 0.9, 0.99)
    for visits in (1, 5, 20, 49):
        a, b = g.halves(x[:20])
        total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
        assert np.allclose(np.take_along_axis(total, g.order(x[:20], visits), 1), np.sort(total, 1)[:, :visits])


def crowd(rng, n, d=64):
    """A third of the vectors near one centre, the others in pairs at cosine 0.91."""
    centre = unit(rng.standard_normal((1, d)))
    hot = unit(centre + 0.01 * rng.standard_normal((n // 3, d)))
    a = unit(rng.standard_normal((n // 3, d)))
    r = rng.standard_normal(a.shape)
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    return hot, a, 0.91 * a + np.sqrt(1 - 0.91 ** 2) * r


def test_a_crowd_takes_no_links_from_others(spark):
    hot, a, b = crowd(np.random.default_rng(5), 4500)
    x = np.concatenate([hot, a, b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.id: r for r in near_duplicates(df).collect()}
    m = len(hot)
    found = [got[m + i].n_links >= 1 and got[m + i].component_id == got[m + m + i].component_id for i in range(m)]
    assert np.mean(found) >= 0.99
    assert all(got[i].n_links >= 0.99 * (m - 1) and got[i].component_id == 0 for i in range(m))


def test_a_hot_cell_in_bounded_memory():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = unit(unit(rng.standard_normal((1, 64))) + 0.001 * rng.standard_normal((8000, 64)))
    g = Grid(x[:500], 4, 0.9, 0.99)
    vec, cell, seen = [v.tobytes() for v in x], g.cells(x), g.order(x, g.visits)
    first = np.bincount(cell // g.k).argmax()
    own = np.flatnonzero(cell // g.k == first)
    asks = [i for i in range(len(x)) if (seen[i] // g.k == first).any()]
    rows = [(0, int(i), int(cell[i]), b"", vec[i]) for i in own]
    rows += [(1, int(i), int(cell[i]), (seen[i][seen[i] // g.k == first] % g.k).astype("<i4").tobytes(), vec[i]) for i in asks]
    role, uid, at, visits, body = map(list, zip(*rows))
    table = pa.table({"role": role, "uid": uid, "w": [1] * len(rows), "cell": at, "visits": visits, "vec": body})
    tracemalloc.start()
    out = vector_index._verify(SimpleNamespace(value=g), 64)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and out.num_rows >= len(own) and set(out["root"].to_pylist()) == {min(uid)}


def test_doubles_stay_doubles(spark):
    c = 0.9
    x, y = [1.0, 0.0], [c - 1e-10, float(np.sqrt(1 - (c - 1e-10) ** 2))]
    df = spark.createDataFrame([(1, x), (2, y), (3, [c + 1e-10, float(np.sqrt(1 - (c + 1e-10) ** 2))])], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2}
