"""Scoring with small heads, blending of scores, and fitting heads as Spark jobs."""

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.once import once
from ..functions.vectors import cosine, dot, pair_features, softmax
from ..session import scratch_path, stored
from ..sources.paths import make_folder, move, open_path


def softmax_t(df: DataFrame, z: str, temperature: float) -> DataFrame:
    """Adds probs, conf and pred (the first label of greatest probability)."""
    return df.withColumn("probs", softmax(F.col(z), temperature)).withColumn("conf", F.array_max("probs")).withColumn(
        "pred", (F.array_position(F.col(z), F.array_max(z)) - 1).cast("int"))


def ensemble_logits(df: DataFrame, z: str) -> DataFrame:
    """(id, label, z): the mean over all members' logits of each id."""
    return df.select("id", F.posexplode(z).alias("label", "z")).groupBy("id", "label").agg(F.avg("z").alias("z"))


def blend(a: Column, b: Column, w: float) -> Column:
    return w * a + (1 - w) * b


def zscore_blend(df: DataFrame, a: str, b: str, w: float) -> DataFrame:
    """Adds `zblend`: both scores standardised over the whole table, then blended."""
    fit = df.agg(F.struct(F.avg(a).alias("ma"), F.stddev_pop(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_pop(b).alias("sb")).alias("f"))
    out = df.withColumn("_f", fit.scalar())
    za = (F.col(a) - F.col("_f.ma")) / F.col("_f.sa")
    zb = (F.col(b) - F.col("_f.mb")) / F.col("_f.sb")
    return out.withColumn("zblend", blend(za, zb, w)).drop("_f")


# --- scoring with given weights --------------------------------------------------------------

@dataclass(frozen=True)
class Head:
    """A linear head (w1, b1), with w2 and b2 one with a hidden ReLU layer, with `more` (weights and biases in turn)
    one with further hidden layers. With mean and sd the inputs are standardised first."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray | None = None
    b2: np.ndarray | None = None
    more: tuple = ()
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return x if self.mean is None else (x - self.mean) / self.sd

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = self.inputs(x)
        parts = _parts(self)
        for i in range(0, len(parts), 2):
            h = (np.maximum(h, 0) if i else h) @ parts[i] + parts[i + 1]
        return h


def head_udf(head: Head):
    """Column function: vector -> logits. The weights are loaded once per task."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, len(head.w1)))
            yield pd.Series(list(head.logits(x)))

    return score


def mlp_score(df: DataFrame, head: Head, vec: str = "vec", out: str = "z") -> DataFrame:
    return df.withColumn(out, head_udf(head)(F.col(vec)))


def ovr_score(df: DataFrame, head: Head, tools: list[str], untrained: set[str], theta: float = 0.3, k: int = 5) -> DataFrame:
    """Adds `tools`: the top k names by sigmoid score from theta up; untrained ones score 0."""
    probs = F.transform(head_udf(head)(F.col("vec")), lambda z: 1 / (1 + F.exp(-z)))
    rows = once(df, _p=probs)
    names = F.array(*[F.lit(t) for t in tools])
    trained = F.array(*[F.lit(t not in untrained) for t in tools])
    scored = F.transform("_p", lambda p, i: F.struct((-F.when(F.get(trained, i), p).otherwise(0.0)).alias("s"), i.alias("i")))
    top = F.filter(F.slice(F.array_sort(scored), 1, k), lambda x: -x["s"] >= theta)
    return rows.withColumn("tools", F.transform(top, lambda x: F.get(names, x["i"]))).drop("_p")


def pair_score(df: DataFrame, u: str, v: str, blocks: str, weights: list[float], bias: float) -> DataFrame:
    """Adds `score`: the logistic of a weighted sum of pair features."""
    f = pair_features(F.col(u), F.col(v), blocks)
    return df.withColumn("score", 1 / (1 + F.exp(-(dot(f, F.array(*[F.lit(float(w)) for w in weights])) + bias))))


def pair_variant_scan(df: DataFrame, us: dict[str, Column], vs: dict[str, Column], positive: Column) -> DataFrame:
    """AUC of the cosine for every combination of a left and a right variant."""
    from .metrics import auc

    combos = F.array(*[
        F.struct(F.lit(a).alias("u"), F.lit(b).alias("v"), cosine(ua, vb).alias("s"))
        for a, ua in us.items() for b, vb in vs.items()])
    rows = df.select(positive.alias("y"), F.explode(combos).alias("c")).select("y", "c.u", "c.v", "c.s")
    return auc(rows, "s", F.col("y"), ["u", "v"])


# --- training ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Recipe:
    """How one head is fitted. width 0 is a linear head, else there are `depth` hidden layers of that width. loss is
    softmax (one gold label) or sigmoid (any number). Rows of the held-out fold are left out of the fit, and of the
    means and deviations if it standardises. l2 is part of the loss, decay shrinks the weights beside the step."""

    name: str
    seed: int = 0
    width: int = 512
    loss: str = "softmax"
    smoothing: float = 0.0
    sens_penalty: float = 0.0
    sensitive: tuple = ()
    dropout: float = 0.0
    l2: float = 1e-3
    lr: float = 1e-3
    held_out: int | None = None
    depth: int = 1
    batch: int = 200
    epochs: int = 200
    decay: float = 0.0
    input_dropout: float = 0.0
    standardise: bool = False


def _init(r: Recipe, d: int, k: int) -> Head:
    rng = np.random.default_rng(r.seed)

    def glorot(a, b):
        lim = np.sqrt(6 / (a + b))
        return rng.uniform(-lim, lim, (a, b))

    if r.width == 0:
        return Head(np.zeros((d, k)), np.zeros(k))
    sizes = [d, *[r.width] * r.depth, k]
    return _head([p for a, b in zip(sizes, sizes[1:]) for p in (glorot(a, b), np.zeros(b))])


def _parts(h: Head) -> list[np.ndarray]:
    return [p for p in (h.w1, h.b1, h.w2, h.b2, *h.more) if p is not None]


def _head(parts: list, like: Head | None = None) -> Head:
    scale = (like.mean, like.sd) if like else (None, None)
    return Head(*(parts + [None, None])[:4], tuple(parts[4:]), *scale)


def dropout_mask(r: Recipe, epoch: int, ids: np.ndarray, width: int, layer: int = 0, out: np.ndarray | None = None) -> np.ndarray | None:
    """Which units of which rows stay, scaled: a hash of (seed, layer, epoch, row id, unit), so it does not
    depend on how rows fall into batches and tasks. Layer -1 is the input."""
    share = r.input_dropout if layer < 0 else r.dropout
    if not share:
        return None
    ids = np.asarray(ids).astype(np.int64).astype(np.uint64)
    out, rows = np.empty((len(ids), width)) if out is None else out, max(1, (1 << 13) // width)
    least = np.uint64(int(np.ceil(share * 2 ** 53)) << 11)  # of a hash whose unit stays: its first 53 bits are at least the share
    with np.errstate(over="ignore"):
        units = np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        salt = np.uint64((layer * 7_368_787 + r.seed * 1_000_003 + epoch) & 0xFFFFFFFFFFFF) * np.uint64(0x165667B19E3779F9)
        ids = ids * np.uint64(0x9E3779B97F4A7C15)
        y = np.empty((min(rows, len(ids)), width), np.uint64)
        for lo in range(0, len(ids), rows):  # pieces that stay in the cache
            x = ids[lo:lo + rows, None] ^ units
            high = y[:len(x)]
            x += salt
            for _ in range(2):
                x ^= np.right_shift(x, 31, out=high)
                x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= np.right_shift(x, 32, out=high)
            np.multiply(x >= least, 1 / (1 - share), out=out[lo:lo + rows])
    return out


def output_gradient(r: Recipe, z: np.ndarray, t: np.ndarray, w: np.ndarray, loss: list | None = None) -> np.ndarray:
    """Gradient of each row's loss by its logits; the summed loss is added to `loss`."""
    k = t.shape[1]
    if r.loss == "softmax":
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        soft = (1 - r.smoothing) * t + r.smoothing / k
        dz = w * (p - soft)
        if loss is not None:
            loss.append(-(w * soft * np.log(p + 1e-12)).sum())
        if r.sens_penalty:
            bad = np.zeros_like(t)
            bad[:, list(r.sensitive)] = 1
            bad *= 1 - t
            mass = (p * bad).sum(1, keepdims=True)
            dz += w * r.sens_penalty * p * (bad - mass)
            if loss is not None:
                loss.append(r.sens_penalty * (w[:, :1] * mass).sum())
        return dz
    p = 1 / (1 + np.exp(-z))
    if loss is not None:
        loss.append(-(w * (t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12))).sum())
    return w * (p - t)


def gradient(r: Recipe, h: Head, x: np.ndarray, t: np.ndarray, w: np.ndarray, keep=None) -> np.ndarray:
    """Summed gradient of the loss over rows with targets t (one column per label) and weights
    w (per row and label), flattened; `keep` scales the hidden units (a list: of each layer). Ends with the loss and the
    row weight."""
    parts = _parts(h)
    keeps = keep if isinstance(keep, list) else [keep] + [None] * len(parts)
    held, open_, z = [], [], x
    for i in range(0, len(parts), 2):
        if i:
            open_.append(z > 0)
            z = np.maximum(z, 0)
            if keeps[i // 2 - 1] is not None:
                z = z * keeps[i // 2 - 1]
        held.append(z)
        z = z @ parts[i] + parts[i + 1]
    loss = []
    dz = output_gradient(r, z, t, w, loss)
    grads = []
    for i in range(len(parts) - 2, -1, -2):
        grads = [held[i // 2].T @ dz, dz.sum(0), *grads]
        if i:
            dz = dz @ parts[i].T
            if keeps[i // 2 - 1] is not None:
                dz = dz * keeps[i // 2 - 1]
            dz = dz * open_[i // 2 - 1]
    return np.concatenate([g.ravel() for g in grads] + [[sum(loss), w[:, 0].sum() if r.loss == "softmax" else len(x)]])


def _batch(b: pa.RecordBatch):
    def matrix(name):
        return np.asarray(b.column(name).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)

    return b.column("id").to_numpy(), matrix("vec"), matrix("target"), matrix("weight"), b.column("fold").to_numpy()


CHUNK = 1 << 16


def train_grid(df: DataFrame, recipes: list[Recipe], epochs: int, fan_in: int = 16) -> list[Head]:
    """Fits all heads of a grid together with Adam on full passes.

    `df` has id, vec, target (array), weight (array), fold. Each pass every task sums the
    gradients of every head over its rows in chunks of `CHUNK` numbers; a chunk's parts are added up
    in a tree of fixed fan-in, and only the total reaches the driver. A pass over the data serves the
    whole grid, and no task holds more than its own rows and sums, or fan_in chunks.
    """
    spark = df.sparkSession
    data = df.select("id", "vec", "target", "weight", F.coalesce("fold", F.lit(-1)).cast("int").alias("fold")).persist()
    try:
        d, k = data.agg(F.max(F.size("vec")), F.max(F.size("target"))).first()
        tasks = data.rdd.getNumPartitions()
        heads = [_init(r, d, k) for r in recipes]
        sizes = [sum(p.size for p in _parts(h)) + 2 for h in heads]
        m = [np.zeros(s - 2) for s in sizes]
        v = [np.zeros(s - 2) for s in sizes]
        for epoch in range(1, epochs + 1):
            shared = spark.sparkContext.broadcast(heads)

            def sums(batches, shared=shared, epoch=epoch):
                from pyspark import TaskContext

                total = None
                for b in batches:
                    if not b.num_rows:
                        continue
                    ids, x, t, w, fold = _batch(b)
                    each = []
                    for r, h in zip(recipes, shared.value):
                        use = slice(None) if r.held_out is None else fold != r.held_out
                        keep = dropout_mask(r, epoch, ids[use], r.width) if h.w2 is not None else None
                        each.append(gradient(r, h, x[use], t[use], w[use], keep))
                    flat = np.concatenate(each)
                    total = flat if total is None else total + flat
                if total is not None:
                    chunks = [total[i:i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(range(len(chunks)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(chunks), pa.int32()),
                        pa.array(chunks, pa.binary())], names=["chunk", "slot", "g"])

            def add(table):
                table = table.sort_by("slot")
                out = sum(np.frombuffer(g) for g in table["g"].to_pylist())
                return pa.table({"chunk": table["chunk"].slice(0, 1), "slot": table["slot"].slice(0, 1), "g": pa.array([out.tobytes()], pa.binary())})

            part, slots = data.mapInArrow(sums, "chunk int, slot int, g binary"), tasks
            while slots > 1:
                slots = -(-slots // fan_in)
                part = part.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int")).groupBy("chunk", "slot").applyInArrow(
                    add, "chunk int, slot int, g binary")
            rows = sorted(part.collect(), key=lambda r: r["chunk"])
            total = np.concatenate([np.frombuffer(r["g"]) for r in rows]) if rows else np.zeros(sum(sizes))
            shared.destroy()
            at = 0
            for i, r in enumerate(recipes):
                piece = total[at:at + sizes[i]]
                at += sizes[i]
                n = max(piece[-1], 1.0)
                heads[i], m[i], v[i] = adam_step(r, heads[i], piece[:-2] / n, m[i], v[i], epoch, n)
        return heads
    finally:
        data.unpersist()


def adam_step(r: Recipe, h: Head, g: np.ndarray, m, v, step: int, n: float):
    """One Adam step; weights (not biases) carry the penalty l2/2 * |w|^2 / n. The decay acts on all parts, outside the moments."""
    parts, out, at = _parts(h), [], 0
    m, v = m.copy(), v.copy()
    for j, p in enumerate(parts):
        new = p.flatten()
        for lo in range(0, p.size, 1 << 14):  # pieces that stay in the cache
            q = new[lo:lo + (1 << 14)]
            s = slice(at + lo, at + lo + len(q))
            adam_piece(r, q, g[s].copy(), m[s], v[s], step, r.l2 / n if j % 2 == 0 else 0, np.empty(len(q)), np.empty(len(q)))
        at += p.size
        out.append(new.reshape(p.shape))
    return _head(out, h), m, v


def adam_piece(r: Recipe, q, g, m, v, step: int, l2: float, a, b) -> None:
    """The step of some parameters q in place, with gradient g, moments m and v, and two arrays to work in; g is spent."""
    even = np.sqrt(1 - 0.999 ** step)  # takes the start out of the second moment
    if l2:
        g += np.multiply(q, l2, out=a)
    m *= 0.9
    m += np.multiply(g, 0.1, out=a)
    v *= 0.999
    np.multiply(g, 0.001, out=a)
    a *= g
    v += a
    np.sqrt(v, out=a)
    a += 1e-8 * even
    np.divide(m, a, out=b)
    b *= r.lr * even / (1 - 0.9 ** step)
    if r.decay:
        q *= 1 - r.lr * r.decay
    q -= b


CELL = 4096  # rows that one task of a step takes
SEGMENT = 1024  # steps that one task takes where a mini-batch is one cell
PROCESSES = 4  # of such a task at most


def _saved(folder: str, cell: int) -> bytes:
    with open_path(f"{folder}/{cell}", "rb") as f:
        return f.read()


def _opened(body):
    return _batch(pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0])


def _flat(ids, x, t, w, fold) -> bytes:
    """A cell as plain numbers, which takes less than a Python object per column to open."""
    head = np.array([len(ids), x.shape[1], t.shape[1], w.shape[1]], np.int64)
    return b"".join(np.ascontiguousarray(a).tobytes() for a in (head, ids.astype(np.int64), fold.astype(np.int64), x, t, w))


def _unflat(body: bytes):
    n, *widths = np.frombuffer(body, np.int64, 4).tolist()
    ids, fold = np.frombuffer(body, np.int64, 2 * n, 32).reshape(2, n)
    ends = np.cumsum([0, *(n * k for k in widths)]).tolist()
    numbers = np.frombuffer(body, np.float64, ends[-1], 32 + 16 * n)
    x, t, w = (numbers[a:b].reshape(n, k) for a, b, k in zip(ends, ends[1:], widths))
    return ids, x, t, w, fold


class Cells:
    """Training rows dealt by a hash of their ids to `steps` mini-batches, and a batch to cells of about CELL rows: one
    partition per cell, so a step runs only the tasks of its batch. A cell holds its rows in the order of the ids and sums
    are taken cell by cell, so nothing depends on how the table was partitioned. The cells lie in the shared folder; with
    `files` each as a file of its own, which any task may read."""

    def __init__(self, df: DataFrame, batch: int | None, files: bool = False):
        rows = df.select("id", "vec", "target", "weight", F.coalesce("fold", F.lit(-1)).cast("int").alias("fold"))
        per = rows.groupBy("fold").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.max(F.size("target")).alias("k")).collect()
        self.rows = {r["fold"]: r["n"] for r in per}
        n = sum(self.rows.values())
        self.d, self.k = max((r["d"] for r in per), default=0), max((r["k"] for r in per), default=1)
        self.steps = max(1, -(-n // batch)) if batch else 1
        self.width = max(1, -(-n // (self.steps * CELL)))

        def pack(table: pa.Table) -> pa.Table:
            body = pa.BufferOutputStream()
            table = table.sort_by([("id", "ascending"), ("fold", "ascending")]).combine_chunks()
            with pa.ipc.new_stream(body, table.schema) as out:
                out.write_table(table)
            return pa.table({"cell": table["cell"].slice(0, 1), "n": pa.array([len(table)], pa.int64()), "body": pa.array([body.getvalue().to_pybytes()], pa.binary())})

        cell = F.pmod(F.xxhash64("id"), F.lit(self.steps * self.width)).cast("int")
        packed = stored(rows.withColumn("cell", cell).groupBy("cell").applyInArrow(pack, "cell int, n long, body binary"), "cells")
        parts = self.steps * self.width
        self.sc = df.sparkSession.sparkContext
        self.folder, self.open = None, _opened
        if files and self.width == 1:
            self.folder, self.open = scratch_path(df.sparkSession, "cells"), _unflat
            folder = self.folder

            def save(batches):
                from pyspark import TaskContext

                make_folder(folder)
                for b in batches:
                    for c, body in zip(b["cell"].to_pylist(), b["body"]):
                        part = f"{folder}/{c}-{TaskContext.get().taskAttemptId()}"
                        with open_path(part, "wb") as f:
                            f.write(_flat(*_opened(body.as_buffer())))
                        move(part, f"{folder}/{c}")
                    yield b.select(["cell", "n"])

            self.filled = {r["cell"]: r["n"] for r in packed.mapInArrow(save, "cell int, n long").collect()}  # rows of the mini-batches
            self.rdd = self.sc.parallelize(sorted(self.filled), max(1, min(len(self.filled), self.sc.defaultParallelism))).map(lambda c: _saved(folder, c))
            return
        # one task per cell is what mini-batches need, and only the RDD interface can run chosen partitions
        self.rdd = packed.rdd.map(lambda r: (r["cell"], bytes(r["body"]))).partitionBy(parts, lambda c: c).values().persist()

    def training(self, held_out: int | None) -> int:
        return sum(n for f, n in self.rows.items() if held_out is None or f != held_out)

    def order(self, epoch: int) -> list[int]:
        return np.random.default_rng(epoch).permutation(self.steps).tolist()

    def total(self, fn, step: int | None = None) -> np.ndarray | None:
        """The sum of fn(ids, x, target, weight, fold) over the cells of a batch, or of all, in their order."""
        def run(bodies, opened=self.open):
            for body in bodies:
                yield fn(*opened(body)).tobytes()

        cells = None if step is None else range(step * self.width, (step + 1) * self.width)
        parts = self.sc.runJob(self.rdd, run, cells)
        return sum(np.frombuffer(p) for p in parts) if parts else None

    def close(self):
        self.rdd.unpersist()

    def scales(self, folds) -> dict:
        """For each held-out fold mean and deviation (+ 1e-6) of the other rows: one pass for the means, one for the
        squares around them, each with a sum per fold."""
        every = sorted(self.rows)

        def per_fold(values):
            return lambda ids, x, t, w, f: np.stack([values(x)[f == g].sum(0) for g in every])

        def others(flat):
            m = flat.reshape(len(every), -1)
            return {h: m[[i for i, g in enumerate(every) if h is None or g != h]].sum(0) / max(1, self.training(h)) for h in folds}

        means = others(self.total(per_fold(lambda x: x)))
        centre = means[folds[0]]
        squares = others(self.total(per_fold(lambda x: (x - centre) ** 2)))
        return {h: (means[h], np.sqrt(np.maximum(0, squares[h] - (means[h] - centre) ** 2)) + 1e-6) for h in folds}


def step_gradient(r: Recipe, h: Head, epoch: int, ids, x, t, w, fold) -> np.ndarray:
    """The summed gradient of a head over the rows of a mini-batch that it learns from, with its dropout of that pass."""
    use = slice(None) if r.held_out is None else fold != r.held_out
    z, n_layers = h.inputs(x[use]), len(_parts(h)) // 2 - 1
    into = dropout_mask(r, epoch, ids[use], z.shape[1], -1)
    keep = [dropout_mask(r, epoch, ids[use], r.width, i) for i in range(n_layers)]
    return gradient(r, h, z if into is None else z * into, t[use], w[use], keep)


def train_batches(df: DataFrame, recipes: list[Recipe]) -> list[Head]:
    """Fits all heads of a grid together with Adam on mini-batches of about `batch` rows, `epochs` passes; the recipes of a
    grid agree in both. Batches are fixed by hash and their order changes with the pass.

    Where a mini-batch is one cell, steps follow each other in segments: a job has one task per head, which takes the head as it
    stands through the next SEGMENT mini-batches, one read at a time, and gives it back; up to PROCESSES processes of the task
    share the blocks of a wide head, if the job leaves cores idle. A task sees a bounded number of
    rows, and there are passes x batches / SEGMENT jobs. Where a mini-batch is more than a cell, a step is a job over its cells
    that serves the whole grid. Only heads or summed gradients reach the driver; both ways give the same weights, wide heads
    but for rounding, however many processes there are."""
    batch, epochs = recipes[0].batch, recipes[0].epochs
    if any((r.batch, r.epochs) != (batch, epochs) for r in recipes):
        raise ValueError("recipes fitted together have one batch size and number of passes")
    standard = any(r.standardise for r in recipes)
    cells = Cells(df, batch, files=True)
    try:
        heads = [_init(r, cells.d, cells.k) for r in recipes]
        if not cells.rows:
            return heads
        scale = cells.scales(list(dict.fromkeys(r.held_out for r in recipes))) if standard else {}
        heads = [replace(h, mean=scale[r.held_out][0], sd=scale[r.held_out][1]) if r.standardise else h for r, h in zip(recipes, heads)]
        sizes = [sum(p.size for p in _parts(h)) for h in heads]
        state = [(h, np.zeros(n), np.zeros(n)) for h, n in zip(heads, sizes)]
        if cells.folder:
            return _in_segments(cells, recipes, state, epochs)
        step = 0
        for epoch in range(1, epochs + 1):
            for b in cells.order(epoch):
                step += 1
                heads = [h for h, _, _ in state]

                def sums(*rows, heads=heads, epoch=epoch):
                    return np.concatenate([step_gradient(r, h, epoch, *rows) for r, h in zip(recipes, heads)])

                total, at = cells.total(sums, b), 0
                if total is None:
                    continue
                for i, r in enumerate(recipes):
                    piece = total[at:at + sizes[i] + 2]
                    at += sizes[i] + 2
                    if piece[-1] > 0:
                        state[i] = adam_step(r, state[i][0], piece[:-2] / piece[-1], *state[i][1:], step, cells.training(r.held_out))
        return [h for h, _, _ in state]
    finally:
        cells.close()


def _in_segments(cells: Cells, recipes: list[Recipe], state: list[tuple], epochs: int) -> list[Head]:
    """The steps of all passes, SEGMENT at a time: one task per head and segment."""
    folder, n = cells.folder, [cells.training(r.held_out) for r in recipes]

    def steps():
        step = 0
        for epoch in range(1, epochs + 1):
            for c in cells.order(epoch):
                step += 1
                if c in cells.filled:
                    yield step, epoch, c

    processes = max(1, min(PROCESSES, cells.sc.defaultParallelism // len(recipes)))  # on cores that no task takes otherwise
    room = max(cells.filled.values())

    def run(one, part):
        from .steps import follow

        return follow(*one, part, lambda c: _unflat(_saved(folder, c)), room, processes)

    every = steps()
    while part := list(islice(every, SEGMENT)):
        state = cells.sc.parallelize(list(zip(recipes, n, state)), len(recipes)).map(lambda one, part=part: run(one, part)).collect()
    return [h for h, _, _ in state]


def train_logistic(df: DataFrame, fits: list[tuple[float, int | None]], iterations: int = 1500, tolerance: float = 1e-9) -> list[Head]:
    """Binary logistic heads with mean log-loss + lam/2n |w|^2 for each (lam, held-out fold) of `fits`, all in the same passes.

    Inputs are standardised by each fit's own training rows. Nesterov steps with momentum 0.9 and step 1/L, where L comes from the
    largest singular value of the inputs, found by power iteration over the same cells. Ends early when no parameter moves
    by more than `tolerance`. One pass is one job; only sums of the size of the parameters reach the driver.
    """
    cells = Cells(df, None)
    try:
        d = cells.d
        if not cells.rows:
            return [Head(np.zeros((d, 1)), np.zeros(1)) for _ in fits]
        folds = list(dict.fromkeys(f for _, f in fits))
        scale = cells.scales(folds)

        def inside(x, fold, h):
            use = slice(None) if h is None else fold != h
            return use, (x[use] - scale[h][0]) / scale[h][1]

        v = np.full((len(folds), d), 1 / np.sqrt(d))
        top = np.zeros(len(folds))
        for _ in range(200):
            def product(ids, x, t, w, fold, v=v):
                out = np.zeros_like(v)
                for i, h in enumerate(folds):
                    z = inside(x, fold, h)[1]
                    out[i] = z.T @ (z @ v[i])
                return out

            new = cells.total(product).reshape(v.shape)
            size = np.linalg.norm(new, axis=1)
            settled = np.abs(size - top) <= 1e-7 * size
            top, v = size, new / np.where(size > 0, size, 1)[:, None]
            if settled.all():
                break
        lam = np.array([x for x, _ in fits])
        at = np.array([folds.index(f) for _, f in fits])
        n = np.array([max(1, cells.training(f)) for _, f in fits])
        step = 1 / (0.25 * 1.01 * top[at] / n + lam / n)
        p, move = np.zeros((len(fits), d + 1)), np.zeros((len(fits), d + 1))
        for _ in range(iterations):
            ahead = p + 0.9 * move

            def sums(ids, x, t, w, fold, ahead=ahead):
                out = np.zeros_like(ahead)
                for i, h in enumerate(folds):
                    use, z = inside(x, fold, h)
                    mine = np.flatnonzero(at == i)
                    miss = 1 / (1 + np.exp(-(z @ ahead[mine, :d].T + ahead[mine, d]))) - t[use][:, :1]
                    out[mine, :d], out[mine, d] = miss.T @ z, miss.sum(0)
                return out

            g = cells.total(sums).reshape(p.shape) / n[:, None]
            g[:, :d] += (lam / n)[:, None] * ahead[:, :d]
            move = 0.9 * move - step[:, None] * g
            p = p + move
            if np.abs(move).max() <= tolerance:
                break
        return [Head(w[:d, None].copy(), w[d:].copy(), mean=scale[f][0], sd=scale[f][1]) for w, (_, f) in zip(p, fits)]
    finally:
        cells.close()


def choose_logistic(df: DataFrame, lams: list[float], folds: int) -> tuple[DataFrame, Head]:
    """(lam, auc) of the pooled held-out scores of each penalty, and the head of the best one (ties: the first given)
    fitted on all rows. `df` has one target column and folds by group."""
    from .metrics import auc

    fits = [(lam, f) for lam in lams for f in [*range(folds), None]]
    heads = train_logistic(df, fits)
    recipes = [Recipe(repr(float(lam)), width=0, loss="sigmoid", held_out=f) for lam, f in fits]
    held = [(r, h) for r, h in zip(recipes, heads) if r.held_out is not None]
    z = held_out_logits(df, [r for r, _ in held], [h for _, h in held])
    gold = df.select("id", (F.col("target")[0] == 1).alias("y"))
    table = auc(z.select("recipe", "id", F.col("z")[0].alias("s")).join(gold, "id"), "s", F.col("y"), ["recipe"])
    scores = {r["recipe"]: r["auc"] for r in table.collect()}  # one row per penalty
    best = max(range(len(lams)), key=lambda i: (scores.get(repr(float(lams[i]))) or 0.0, -i))
    head = next(h for h, fit in zip(heads, fits) if fit == (lams[best], None))
    return table.select(F.col("recipe").cast("double").alias("lam"), "auc"), head


def held_out_logits(df: DataFrame, recipes: list[Recipe], heads: list[Head]) -> DataFrame:
    """(recipe, seed, fold, id, z): the logits of each row under every head that left out its fold."""
    by_fold: dict = {}
    for r, h in zip(recipes, heads):
        by_fold.setdefault(r.held_out, []).append((r.name, r.seed, h))
    shared = df.sparkSession.sparkContext.broadcast(by_fold)

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, _, _, fold = _batch(b)
            for f, members in shared.value.items():
                use = fold == f
                if not use.any():
                    continue
                for name, seed, h in members:
                    z = h.logits(x[use])
                    yield pa.RecordBatch.from_pydict({
                        "recipe": [name] * len(z), "seed": pa.array([seed] * len(z), pa.int32()),
                        "fold": pa.array([f] * len(z), pa.int32()), "id": ids[use], "z": list(z)})

    cols = df.select("id", "vec", "target", "weight", F.col("fold").cast("int").alias("fold"))
    return cols.mapInArrow(score, "recipe string, seed int, fold int, id bigint, z array<double>")


def one_hot(label: Column, k: int) -> Column:
    return F.array(*[(label == i).cast("double") for i in range(k)])


def training_rows(df: DataFrame, k: int) -> DataFrame:
    """Columns the trainer needs from (id, vec, label, fold), each row with weight 1."""
    return df.select("id", "vec", "fold", "label", one_hot(F.col("label"), k).alias("target"),
                     F.array_repeat(F.lit(1.0), k).alias("weight"))


def fold_grid(recipes: list[Recipe], folds: int) -> list[Recipe]:
    return [replace(r, held_out=f) for r in recipes for f in range(folds)]


def fit_grid(df: DataFrame, recipes: list[Recipe], folds: int, epochs: int | None = None) -> DataFrame:
    """All recipes x folds fitted together, in the recipes' mini-batches or in `epochs` full passes; the held-out
    logits of every row."""
    grid = fold_grid(recipes, folds)
    return held_out_logits(df, grid, train_grid(df, grid, epochs) if epochs else train_batches(df, grid))


def oof_table(logits: DataFrame, gold: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Pooled out-of-fold predictions: (recipe, seed, fold, id, label, pred, conf)."""
    return softmax_t(logits.join(gold.select("id", "label"), "id"), "z", temperature).select(
        "recipe", "seed", "fold", "id", "label", "pred", "conf")


def train_logreg(df: DataFrame, c: float = 20.0, iterations: int = 500):
    """Multinomial logistic regression on (vec, label); c weighs the data against the penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    rows = df.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    fit = LogisticRegression(featuresCol="features", labelCol="label", regParam=1 / (c * n), maxIter=iterations,
                             standardization=False, family="multinomial").fit(rows)
    return Head(fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray())


NO_POSITIVES_BIAS = -20.0


def train_ovr_balanced(df: DataFrame, tools: list[str], epochs: int, lr: float = 0.05) -> Head:
    """One logistic per tool on (id, vec, gold: array of names), the two classes of each tool
    weighing the same; a tool no row needs gets a bias that keeps it silent."""
    hot = F.array(*[F.array_contains("gold", t).cast("double") for t in tools])
    rows = df.withColumn("target", hot)
    counts = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("target")[i]).alias(f"p{i}") for i in range(len(tools))]).first()
    n = counts["n"]
    pos = [counts[f"p{i}"] for i in range(len(tools))]
    up = [n / (2 * p) if p else 0.0 for p in pos]
    down = [n / (2 * (n - p)) if n > p else 0.0 for p in pos]
    weight = F.array(*[F.when(F.col("target")[i] == 1, up[i]).otherwise(down[i] if pos[i] else 0.0) for i in range(len(tools))])
    rows = rows.withColumn("weight", weight).withColumn("fold", F.lit(None).cast("int"))
    head, = train_batches(rows, [Recipe("ovr", width=0, loss="sigmoid", lr=lr, batch=max(1, n), epochs=epochs)])
    return Head(head.w1, np.where(np.array(pos) > 0, head.b1, NO_POSITIVES_BIAS))


def cv_auc(df: DataFrame, recipes: list[Recipe], folds: int, epochs: int | None = None) -> DataFrame:
    """AUC of a binary head per recipe, seed and held-out fold. `df` has one target column."""
    from .metrics import auc

    z = fit_grid(df, recipes, folds, epochs).select("recipe", "seed", "fold", "id", F.col("z")[0].alias("s"))
    gold = df.select("id", (F.col("target")[0] == 1).alias("y"))
    return auc(z.join(gold, "id"), "s", F.col("y"), ["recipe", "seed", "fold"])
