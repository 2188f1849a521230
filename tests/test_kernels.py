"""Kernels of near duplicates and bootstraps against plain loops, in small blocks and ranges."""

import hashlib
import random

import numpy as np

from corvane.operators import dedup as D
from corvane.operators import metrics as E


def grams(text):
    s = "".join(text.lower().split())
    return {s} if len(s) < 3 else {s[i:i + 3] for i in range(len(s) - 2)}


def test_near_duplicates_in_blocks_and_bands(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdef ", k=rng.choice([4, 12, 40, 160]))) for _ in range(30)]
    texts = [b if rng.random() < 0.3 else "".join(c if rng.random() > 0.03 else "x" for c in b) + "y" * rng.randint(0, 3) for b in base * 4]
    texts += ["hot words"] * 40 + ["", " ", "ab"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    half = len(rows) // 2
    q, r = rows[:half], rows[half:]
    want = {}
    for i, t in q:
        best = max(((len(grams(t) & grams(u)) / len(grams(t) | grams(u)), -j) for j, u in r))
        if best[0] > 0.6:
            want[i] = (best[0], -best[1])
    dfs = [spark.createDataFrame(x, "id long, text string").repartition(3) for x in (q, r)]
    for block in (3, 10, None):
        got = {x.id: (x.max_jac, x.nn_jac) for x in D.near_dup_ngram(*dfs, "id", "text", 0.6, block=block).collect()}
        assert got == want and len(want) > 20
    assert D.near_dup_ngram(dfs[0].limit(0), dfs[1], "id", "text", 0.6).count() == 0


def draws(seed, b, keys):
    def one(r, k):
        u = int(hashlib.md5(f"{seed}-{r}-{k}".encode()).hexdigest()[:8], 16) / 2 ** 32
        return sum(c <= u for c in E.POISSON1_CDF)

    return np.array([[one(r, k) for r in range(b)] for k in keys], float)


def test_draws_and_sums(spark):
    keys = list(range(70))
    w = draws("s", 30, keys)
    assert (E.Draws("s", 30).of(keys) == w).all()
    df = spark.createDataFrame([(k, k * 0.5 if k % 7 else None) for k in keys], "id long, x double").repartition(5)
    x = np.array([k * 0.5 if k % 7 else 0.0 for k in keys])
    got = {r.rep: (r.n, r.x) for r in E.replicate_sums(df, "id", 30, "s", {"n": E.F.lit(1), "x": E.F.col("x")}).collect()}
    assert all(np.allclose(got[r], (w[:, r].sum(), w[:, r] @ x)) for r in range(30)) and len(got) == 30


def test_auc_of_replicates_over_ranges_and_ties(spark, monkeypatch):
    monkeypatch.setattr(E.Draws, "ROWS", 7)  # chunks end inside ties
    rng = random.Random(8)
    rows = [(i, rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()]), rng.random() < 0.4) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, s double, y boolean").repartition(4)
    w = draws("q", 25, [r[0] for r in rows])
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    beats = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
    got = {r.rep: r.auc for r in E.replicate_auc(df, "id", "s", "y", 25, "q").collect()}
    for r in range(25):
        assert abs(got[r] - w[y, r] @ beats @ w[~y, r] / w[y, r].sum() / w[~y, r].sum()) < 1e-12
    assert E.replicate_auc(df.filter("y"), "id", "s", "y", 5, "q").count() == 0
