"""Adam steps of one head that follow each other in a task: the arithmetic of `gradient` and `adam_step` of models.py in
place, in blocks that a few processes of the task share: threads would wait for the interpreter at every short operation."""

import mmap
import os
from threading import Lock

import numpy as np

from .models import Recipe, _head, _parts, adam_piece, dropout_mask, output_gradient

WIDE = ((1 << 14, 4),)  # (parameters, blocks) from which a head is worked in so many blocks
PIECE = 1 << 13  # parameters of an Adam step that stay in the cache


def blocks_of(params: int) -> int:
    """How many blocks a head is worked in. It depends on the head alone, not on the processes, so neither do the sums."""
    return next((n for size, n in WIDE if params >= size), 1)


def _cuts(n: int, blocks: int) -> list[int]:
    return [n * i // blocks for i in range(blocks + 1)]


class Meeting:
    """Where the processes of a task wait for each other: each counts what it has done in shared memory."""

    def __init__(self, processes: int):
        self.marks = memoryview(mmap.mmap(-1, 64 * (processes + 1))).cast("q")  # eight numbers, a cache line, each
        self.others, self.failed = list(range(processes)), 8 * processes
        self.me, self.parent, self.children, self.turn, self.fence = 0, os.getpid(), [], 0, Lock()

    def wait(self):
        self.turn += 1
        with self.fence:  # what was written before is seen before the count
            pass
        self.marks[8 * self.me] = self.turn
        for i in self.others:
            tries = 0
            while self.marks[8 * i] < self.turn:
                os.sched_yield()
                tries += 1
                if self.marks[self.failed] or not tries % 1024 and self._alone(i):
                    raise RuntimeError("a process of the task failed")
        with self.fence:
            pass

    def _alone(self, i: int) -> bool:
        """A process is gone that process i waits for: its parent, or a child that ended before it counted on."""
        if self.me:
            return os.getppid() != self.parent
        gone = os.waitid(os.P_PID, self.children[i - 1], os.WEXITED | os.WNOHANG | os.WNOWAIT)
        return gone is not None and self.marks[8 * i] < self.turn

    def run(self, fn) -> None:
        """fn(i) in process i of the task: forked ones, and this one as the first."""
        codes = []
        try:
            for i in self.others[1:]:
                child = os.fork()
                if not child:
                    code = 1
                    try:
                        self.me = i
                        fn(i)
                        code = 0
                    finally:
                        if code:
                            self.marks[self.failed] = 1
                        os._exit(code)
                self.children.append(child)
            fn(0)
        except BaseException:
            self.marks[self.failed] = 1
            raise
        finally:
            codes += [os.waitpid(child, 0)[1] for child in self.children]
        if any(codes):
            raise RuntimeError("a process of the task failed")


class Follower:
    """A head in one flat array with its moments, and room for the rows of a mini-batch, in shared memory."""

    def __init__(self, r: Recipe, n: float, head, m: np.ndarray, v: np.ndarray, room: int, processes: int):
        self.r, self.n, self.like = r, n, head
        parts = _parts(head)
        self.shapes = [p.shape for p in parts]
        self.starts = np.cumsum([0, *[p.size for p in parts]]).tolist()
        self.flat, self.m, self.v, self.g = (self._shared(self.starts[-1]) for _ in range(4))
        self.flat[:], self.m[:], self.v[:] = np.concatenate([p.ravel() for p in parts]), m, v
        self.p, self.gp = self._views(self.flat), self._views(self.g)
        self.z, self.k, self.d = ([self._shared(room, s[1]) for s in shapes] for shapes in (self.shapes[:-2:2], self.shapes[:-2:2], self.shapes[::2]))
        self.scratch = np.empty(PIECE), np.empty(PIECE)
        self.blocks = blocks_of(self.starts[-1])
        self.processes = max(1, min(processes, self.blocks))

    @staticmethod
    def _shared(*shape):
        return np.frombuffer(mmap.mmap(-1, max(8, 8 * int(np.prod(shape)))))[:int(np.prod(shape))].reshape(shape)

    def _views(self, flat):
        return [flat[a:b].reshape(s) for a, b, s in zip(self.starts, self.starts[1:], self.shapes)]

    def _rows(self, epoch: int, ids, x, t, w, fold):
        """The rows that a step learns from."""
        r = self.r
        use = slice(None) if r.held_out is None else fold != r.held_out
        ids, z, t, w = ids[use], self.like.inputs(x[use]), t[use], w[use]
        into = dropout_mask(r, epoch, ids, z.shape[1], -1)
        return ids, z if into is None else z * into, t, w, w[:, 0].sum() if r.loss == "softmax" else len(z)

    def run(self, part: list[tuple], load) -> tuple:
        meeting = Meeting(self.processes)

        def steps(i):
            mine = range(i, self.blocks, self.processes)
            for step, epoch, c in part:
                rows = self._rows(epoch, *load(c))
                if not rows[-1] > 0:
                    continue
                for phase in (self._rowwise, self._unitwise):
                    for block in mine:
                        phase(block, step, epoch, *rows)
                    meeting.wait()

        meeting.run(steps)
        return _head([p.copy() for p in self.p], self.like), self.m.copy(), self.v.copy()

    def _rowwise(self, block, step, epoch, ids, x, t, w, weight):
        """Forward and backward through all layers for some of the rows."""
        r, layers, cut = self.r, len(self.p) // 2, _cuts(len(x), self.blocks)
        at = slice(cut[block], cut[block + 1])
        if at.start == at.stop:
            return
        z = x[at]
        for k in range(layers - 1):
            z = np.matmul(z, self.p[2 * k], out=self.z[k][at])
            z += self.p[2 * k + 1]
            stay = self.k[k][at]  # what the unit and its gradient are scaled by
            if dropout_mask(r, epoch, ids[at], r.width, k, stay) is None:
                stay[:] = z > 0
            else:
                stay *= z > 0
            z *= stay
        top = z @ self.p[-2]
        top += self.p[-1]
        self.d[-1][at] = output_gradient(r, top, t[at], w[at])
        for k in range(layers - 1, 0, -1):
            back = np.matmul(self.d[k][at], self.p[2 * k].T, out=self.d[k - 1][at])
            back *= self.k[k - 1][at]

    def _unitwise(self, block, step, epoch, ids, x, t, w, weight):
        """Gradient of some of each layer's inputs over all rows, and their step; the last block has the biases."""
        n = len(x)
        for k, z in enumerate([x, *self.z]):
            size, wide = self.shapes[2 * k]
            cut, start, d = _cuts(size, self.blocks), self.starts[2 * k], self.d[k][:n]
            a, b = cut[block], cut[block + 1]
            if a < b:
                np.matmul(z[:n, a:b].T, d, out=self.gp[2 * k][a:b])
                self._adam(start + a * wide, start + b * wide, weight, step, self.r.l2 / self.n)
            if block == self.blocks - 1:
                d.sum(0, out=self.gp[2 * k + 1])
                self._adam(start + size * wide, start + size * wide + wide, weight, step, 0)

    def _adam(self, lo, hi, weight, step, l2):
        for a in range(lo, hi, PIECE):
            s = slice(a, min(a + PIECE, hi))
            g = self.g[s]
            g /= weight
            adam_piece(self.r, self.flat[s], g, self.m[s], self.v[s], step, l2, *(x[:len(g)] for x in self.scratch))


def follow(r: Recipe, n: float, state: tuple, part: list[tuple], load, room: int, processes: int) -> tuple:
    """The state of a head after the steps of `part`, (step, epoch, mini-batch) each, of mini-batches of at most `room` rows."""
    return Follower(r, n, *state, room, processes).run(part, load)
