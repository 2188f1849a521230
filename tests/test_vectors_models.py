import numpy as np
from pyspark.sql import functions as F

from corvane.operators import metrics as E
from corvane.operators import models as M
from corvane.operators import vectors as V
from corvane.session import scratch_path
from corvane.sources.keyed_f32 import read_keyed_f32, write_keyed_f32

RNG = np.random.default_rng(0)


def vecs(spark, n, d=8, seed=0, first=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    rows = [(first + i, [float(a) for a in v], i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<float>, label int"), x


def unit(x):
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_broadcast_and_block_ways_agree_with_numpy(spark):
    q, xq = vecs(spark, 60, seed=1)
    r, xr = vecs(spark, 45, seed=2, first=1000)
    s = unit(xq) @ unit(xr).T
    want = {i: (round(s[i].max(), 9), 1000 + int(s[i].argmax())) for i in range(60)}
    for sizes in ({}, {"broadcast_bytes": 0, "block_rows": 16}):
        got = {a["id"]: (round(a["max_cos"], 9), a["nn"]) for a in V.nearest(q, r, **sizes).collect()}
        assert got == want
        per = {(a["id"], a["label"]): a["sim"] for a in V.max_sim_per_label(q, r, **sizes).collect()}
        for lab in range(3):
            assert np.allclose([per[(i, lab)] for i in range(60)], s[:, lab::3].max(1))
        st = {a["id"]: a["mean"] for a in V.pair_similarity(q, r, **sizes).collect()}
        assert np.allclose([st[i] for i in range(60)], s.mean(1))


def test_equal_vectors_give_the_least_id(spark):
    q, x = vecs(spark, 4, seed=3)
    rows = [(100 - k, [float(a) for a in x[0]]) for k in range(5)]
    r = spark.createDataFrame(rows, "id long, vec array<float>")
    for sizes in ({}, {"broadcast_bytes": 0, "block_rows": 2}):
        assert {a["nn"] for a in V.nearest(q, r, **sizes).collect()} == {96}


def test_keyed_vector_files_in_row_ranges(spark):
    df, x = vecs(spark, 50)
    path = scratch_path(spark, "kv")
    assert write_keyed_f32(df, path, "id", "vec") == 50
    got = {int(r["key"]): r["vec"] for r in read_keyed_f32(spark, path, 8, rows_per_range=3).collect()}
    assert len(got) == 50 and all(np.array_equal(np.float32(got[i]), x[i]) for i in range(50))


def test_gradient_matches_finite_differences():
    x, t = RNG.normal(size=(12, 4)), np.eye(3)[RNG.integers(0, 3, 12)]
    w = np.ones_like(t)
    for r in (M.Recipe("s", width=5, smoothing=0.1, sens_penalty=0.5, sensitive=(2,)), M.Recipe("g", width=5, loss="sigmoid"), M.Recipe("l", width=0)):
        h = M._init(r, 4, 3)
        if r.width == 0:
            h = M.Head(RNG.normal(size=(4, 3)), np.zeros(3))
        g = M.gradient(r, h, x, t, w)
        parts, at = M._parts(h), 0
        for p in parts:
            for j in range(min(4, p.size)):
                old = p.flat[j]
                p.flat[j] = old + 1e-6
                up = M.gradient(r, h, x, t, w)[-2]
                p.flat[j] = old - 1e-6
                down = M.gradient(r, h, x, t, w)[-2]
                p.flat[j] = old
                assert abs((up - down) / 2e-6 - g[at + j]) < 1e-4
            at += p.size


def test_distributed_fit_equals_one_machine(spark):
    df, x = vecs(spark, 60, d=5)
    rows = M.training_rows(df.withColumn("fold", (F.col("id") % 2).cast("int")), 3).repartition(4)
    grid = M.fold_grid([M.Recipe("a", width=4, lr=0.05), M.Recipe("b", width=0, lr=0.05)], 2)
    heads = M.train_grid(rows, grid, 5)
    ids = np.arange(60)
    for r, got in zip(grid, heads):
        h, m, v = M._init(r, 5, 3), 0, 0
        use = ids % 2 != r.held_out
        m = v = np.zeros(sum(p.size for p in M._parts(h)))
        for e in range(1, 6):
            g = M.gradient(r, h, x[use].astype(float), np.eye(3)[ids[use] % 3], np.ones((use.sum(), 3)))
            h, m, v = M.adam_step(r, h, g[:-2] / g[-1], m, v, e, g[-1])
        assert all(np.allclose(a, b) for a, b in zip(M._parts(h), M._parts(got)))
    z = M.held_out_logits(rows, grid, heads)
    assert z.count() == 60 * 2
    assert z.filter((F.col("id") % 2) != F.col("fold")).count() == 0


def test_unneeded_tool_stays_silent(spark):
    df, _ = vecs(spark, 30, d=4)
    rows = df.withColumn("gold", F.array(F.concat(F.lit("t"), F.col("label"))))
    head = M.train_ovr_balanced(rows, ["t0", "t1", "t2", "none"], 3)
    assert head.b1[3] == -20 and np.all(head.w1[:, 3] == 0)


def test_auc_with_ties_and_one_class(spark):
    rows = [(0.1, False, "a"), (0.5, True, "a"), (0.5, False, "a"), (0.9, True, "a"), (0.3, True, "b")]
    df = spark.createDataFrame(rows, "s double, y boolean, g string")
    got = {r["g"]: r["auc"] for r in E.auc(df, "s", F.col("y"), ["g"]).collect()}
    assert got == {"a": 0.875}
    same = spark.createDataFrame([(0.5, i % 2 == 0) for i in range(10)], "s double, y boolean")
    assert E.auc(same, "s", F.col("y")).first()["auc"] == 0.5


def test_ece_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, False), (0.0, True), (1.0, True)], "conf double, ok boolean")
    bins = {r["bin"]: r["n"] for r in E.reliability_bins(df, min_n=1).collect()}
    assert bins == {1: 1, 2: 1, 10: 1}
    assert abs(E.ece(df).first()["ece"] - (0.9 + 0.2 + 0) / 4) < 1e-12
