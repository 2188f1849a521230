"""Steps of wide heads are shared by processes of a task, with the same weights."""

import os
from dataclasses import replace

import numpy as np
import pytest

from corvane.operators import models as M
from corvane.operators import steps as S

WIDE = M.Recipe("r", width=140, depth=2, lr=0.01, dropout=0.3, smoothing=0.05, sens_penalty=0.5, sensitive=(1,), held_out=2)


def batches(k=5, n=37, d=12):
    rng = np.random.default_rng(3)
    for i in range(k):
        yield np.arange(n) * 5 + i, rng.normal(size=(n, d)), np.eye(3)[rng.integers(0, 3, n)], np.ones((n, 3)), rng.integers(0, 3, n)


@pytest.mark.parametrize("recipe", [WIDE, replace(WIDE, depth=1, width=1100, dropout=0.0, l2=0.0, decay=0.1, input_dropout=0.2)])
def test_wide_heads_are_shared_by_processes_and_have_the_weights_of_plain_steps(recipe, tmp_path):
    rows = list(batches())
    h = M._init(recipe, 12, 3)
    size = sum(p.size for p in M._parts(h))
    start, part = (h, np.zeros(size), np.zeros(size)), [(s, 1 + s // 4, s % 5) for s in range(1, 13)]
    want = start
    for step, epoch, c in part:
        g = M.step_gradient(recipe, want[0], epoch, *rows[c])
        want = M.adam_step(recipe, want[0], g[:-2] / g[-1], *want[1:], step, 100)
    for processes in (1, 2, 4):
        def load(c, processes=processes):
            (tmp_path / f"{processes}-{os.getpid()}").touch()
            return rows[c]

        got = S.follow(recipe, 100, start, part, load, 40, processes)
        assert len(list(tmp_path.glob(f"{processes}-*"))) == processes
        assert all(np.allclose(a, b, atol=1e-10) for a, b in zip(M._parts(got[0]), M._parts(want[0])))
        first = got if processes == 1 else first
        assert all((a == b).all() for a, b in zip(M._parts(got[0]), M._parts(first[0]))) and (got[2] == first[2]).all()


@pytest.mark.parametrize("fault", [lambda: 1 / 0, lambda: os.kill(os.getpid(), 9)])
def test_a_failed_process_fails_the_task(fault):
    rows, me = list(batches()), os.getpid()
    h = M._init(WIDE, 12, 3)
    size = sum(p.size for p in M._parts(h))

    def load(c):
        if os.getpid() != me and c == 3:
            fault()
        return rows[c]

    with pytest.raises(RuntimeError):
        S.follow(WIDE, 100, (h, np.zeros(size), np.zeros(size)), [(s + 1, 1, s) for s in range(5)], load, 40, 4)


def test_cells_are_kept_as_plain_numbers(spark):
    for got, want in zip(M._unflat(M._flat(*(rows := next(batches())))), rows):
        assert (got == want).all() and got.shape == want.shape
    df = spark.range(50).selectExpr("id", "array(id / 7D, 1D) AS vec", "array(double(id % 2)) AS target", "array(1D) AS weight", "int(id % 3) AS fold")
    cells = M.Cells(df, 10, files=True)
    ids = [M._unflat(M._saved(cells.folder, c))[0] for c in cells.filled]
    assert sorted(np.concatenate(ids)) == list(range(50)) and [len(i) for i in ids] == list(cells.filled.values())
