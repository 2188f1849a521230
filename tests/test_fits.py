"""Mini-batch and convex fits: gradients, batches that do not depend on partitions, and solutions found otherwise."""

from dataclasses import replace

import numpy as np
import pytest

from corvane.operators import models as M

BASE = M.Recipe("r", width=9, batch=40, epochs=6, lr=0.01, dropout=0.3, smoothing=0.05, sens_penalty=0.5, sensitive=(2,))


def table(spark, n=150, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 2, 3, 4, 5, 6] + 1
    y = (x @ rng.normal(size=d) + rng.normal(size=n) * 3 > 2).astype(int)
    rows = [(i, v.tolist(), int(c + (i % 5 == 0)), i % 3) for i, (v, c) in enumerate(zip(x, y))]
    return x, y, M.training_rows(spark.createDataFrame(rows, "id long, vec array<double>, label int, fold int"), 3)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_backpropagation_through_hidden_layers(depth):
    rng = np.random.default_rng(1)
    r = replace(BASE, width=5, depth=depth)
    x, t, w = rng.normal(size=(7, 4)), np.eye(3)[rng.integers(0, 3, 7)], np.ones((7, 3))
    keep = [M.dropout_mask(r, 1, np.arange(7), 5, i) for i in range(depth)]
    h = M._init(r, 4, 3)
    assert len(M._parts(h)) == 2 * (depth + 1)
    flat = np.concatenate([p.ravel() for p in M._parts(h)]) + 0.1 * rng.normal(size=sum(p.size for p in M._parts(h)))

    def loss(v):
        parts, at = [], 0
        for p in M._parts(h):
            parts.append(v[at:at + p.size].reshape(p.shape))
            at += p.size
        return M.gradient(r, M._head(parts), x, t, w, keep)

    g = loss(flat)
    for i in rng.integers(0, len(flat), 25):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        assert abs((loss(flat + e)[-2] - loss(flat - e)[-2]) / 2e-6 - g[i]) < 1e-5


@pytest.mark.parametrize("depth", [1, 2])
def test_weights_are_the_same_for_one_and_four_partitions(spark, monkeypatch, depth):
    monkeypatch.setattr(M, "CELL", 16)  # several cells in a batch
    _, _, df = table(spark)
    grid = M.fold_grid([replace(BASE, depth=depth), replace(BASE, depth=depth, seed=1, standardise=True, decay=0.1, input_dropout=0.2)], 2)
    one, four, dealt = (M.train_batches(p, grid) for p in (df.coalesce(1), df.repartition(4), df.repartition(7, "label")))
    for other in (four, dealt):
        assert all((a == b).all() for g, h in zip(one, other) for a, b in zip(M._parts(g), M._parts(h)))


def test_batches_follow_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 16)
    x, _, df = table(spark)
    r = replace(BASE, depth=2, decay=0.05, standardise=True, held_out=1)
    head, = M.train_batches(df, [r])
    cells = M.Cells(df, r.batch)
    where = {}
    for c in range(cells.steps * cells.width):
        for body in cells.sc.runJob(cells.rdd, list, [c]):
            where.update({i: c // cells.width for i in M.pa.ipc.open_stream(body).read_all()["id"].to_pylist()})
    assert len(where) == 150 and len(set(where.values())) == 4
    rows = {q["id"]: q for q in df.collect()}
    train = [i for i in rows if rows[i]["fold"] != 1]
    mean, sd = x[train].mean(0), x[train].std(0) + 1e-6
    h, step = replace(M._init(r, 6, 3), mean=mean, sd=sd), 0
    m = v = np.zeros(sum(p.size for p in M._parts(h)))
    for epoch in range(1, r.epochs + 1):
        for b in cells.order(epoch):
            ids = np.array(sorted(i for i in train if where[i] == b))
            step += 1
            t = np.array([rows[i]["target"] for i in ids])
            keep = [M.dropout_mask(r, epoch, ids, r.width, k) for k in range(2)]
            g = M.gradient(r, h, (x[ids] - mean) / sd, t, np.ones_like(t), keep)
            h, m, v = M.adam_step(r, h, g[:-2] / len(ids), m, v, step, len(train))
    cells.close()
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(M._parts(head), M._parts(h)))
    assert np.allclose(head.mean, mean) and np.allclose(head.sd, sd)


def test_segments_take_few_jobs_and_give_the_weights_of_single_steps(spark, monkeypatch):
    _, _, df = table(spark)
    grid = M.fold_grid([replace(BASE, batch=4), replace(BASE, batch=4, seed=1, depth=2, standardise=True, decay=0.1, input_dropout=0.2)], 2)
    monkeypatch.setattr(M, "SEGMENT", 50)  # ends inside a pass; 38 batches, some of them empty
    spark.sparkContext.setJobGroup("fit", "fit")
    heads = M.train_batches(df, grid)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs < 30  # a job per step makes more than 200
    real = M.Cells
    monkeypatch.setattr(M, "Cells", lambda df, batch, files=False: real(df, batch))
    assert all((a == b).all() for g, h in zip(heads, M.train_batches(df, grid)) for a, b in zip(M._parts(g), M._parts(h)))


def test_decay_stays_outside_the_moments():
    h = M.Head(np.ones((2, 1)), np.ones(1))
    zero = np.zeros(3)
    out, m, v = M.adam_step(replace(BASE, l2=0.0, lr=0.1, decay=0.5), h, zero, zero, zero, 1, 10)
    assert np.allclose(out.w1, 0.95) and np.allclose(out.b1, 0.95) and not m.any() and not v.any()


def newton(x, y, lam):
    n, d = x.shape
    z, w = np.hstack([x, np.ones((n, 1))]), np.zeros(d + 1)
    ridge = np.diag([lam] * d + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return w


def pairs(spark):
    x, y, _ = table(spark)
    rows = [(i, v.tolist(), [float(c)], [1.0], i % 3) for i, (v, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, vec array<double>, target array<double>, weight array<double>, fold int")


def test_logistic_heads_are_the_convex_optimum(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 32)
    x, y, df = pairs(spark)
    fits = [(lam, f) for lam in (1.0, 10.0) for f in (0, 2, None)]
    for (lam, f), h in zip(fits, M.train_logistic(df.repartition(5), fits)):
        use = np.array([f is None or i % 3 != f for i in range(len(x))])
        s = (x[use] - x[use].mean(0)) / (x[use].std(0) + 1e-6)
        assert np.allclose(np.append(h.w1[:, 0], h.b1), newton(s, y[use], lam), atol=1e-6), (lam, f)


def test_lambda_is_chosen_on_held_out_rows_and_refitted_on_all(spark):
    x, y, df = pairs(spark)
    per, head = M.choose_logistic(df, [0.1, 3000.0, 10.0], 3)
    want = {}
    for lam in (0.1, 3000.0, 10.0):
        s = np.zeros(len(y))
        for f in range(3):
            tr = np.arange(len(y)) % 3 != f
            mu, sd = x[tr].mean(0), x[tr].std(0) + 1e-6
            w = newton((x[tr] - mu) / sd, y[tr], lam)
            s[~tr] = ((x[~tr] - mu) / sd) @ w[:-1] + w[-1]
        want[lam] = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    got = {r.lam: r.auc for r in per.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    best = max(want, key=want.get)
    assert np.allclose(head.w1[:, 0], newton((x - x.mean(0)) / (x.std(0) + 1e-6), y, best)[:-1], atol=1e-6)


def test_empty_table(spark):
    _, _, df = pairs(spark)
    assert not M.train_logistic(df.limit(0), [(1.0, None)])[0].b1.any()
    assert len(M.train_batches(df.limit(0), [replace(BASE, width=0)])) == 1
