"""Operator 12, whitening of embeddings by eigenvectors refined beyond double precision.

Vectors become integers (`floor(scale * c)`), and equal ones count once. Sums and products of the integers
are exact and so do not depend on the order in which tasks finish: the products are taken of vectors
centred on the whole part of the mean, and its fraction is put right afterwards, in integers too. The
covariance is therefore known exactly, whatever its size.

Its eigenvectors are first found in float32 and then corrected by the iteration of Ogita and Aishima, which only
multiplies matrices, in extended precision (`numpy.longdouble`; 64 bits of mantissa on x86). Eigenvalues closer
together than the error of a step, or than CLOSE, cannot be divided by their gap; their vectors are kept as one
subspace, and its small projected problem, shifted by the cluster's mean, is solved by itself in each step.

The driver and a task hold a matrix of dimension squared, never vectors of all rows.
"""

from __future__ import annotations

import json
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FAN_IN = 16  # matrices that one merging task adds
BATCH = 4096  # vectors turned into a matrix at once
LONG = 2 ** 63
STEPS = 40
CLOSE = 2.0 ** -28  # gap, as a share of the matrix, below which rounding divided by it would bend the basis
OUT = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def pack(flat: np.ndarray, dim: int) -> list[bytes]:
    """Each vector in the narrowest of 2, 4 and 8 bytes a number, so that equal vectors are equal bytes."""
    x = flat.astype("<i8").reshape(-1, dim)
    low, high = x.min(1), x.max(1)
    out = []
    for row, a, b in zip(x, low.tolist(), high.tolist()):
        kind = "<i2" if -2 ** 15 <= a and b < 2 ** 15 else "<i4" if -2 ** 31 <= a and b < 2 ** 31 else "<i8"
        out.append(row.astype(kind).tobytes())
    return out


def unpack(bodies: list[bytes], dim: int) -> np.ndarray:
    kinds = {2 * dim: "<i2", 4 * dim: "<i4", 8 * dim: "<i8"}
    return np.stack([np.frombuffer(b, kinds[len(b)]) for b in bodies]).astype(np.int64)


def product(z: np.ndarray) -> np.ndarray:
    """z'z of integers, exactly; object numbers where the machine's own would round or overflow."""
    if not len(z):
        return np.zeros((z.shape[1],) * 2, object)
    top = max(abs(int(z.min())), abs(int(z.max())))
    if top * top * len(z) < 2 ** 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def minus(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre without overflow."""
    top = max(abs(int(x.min())), abs(int(x.max())), *(abs(c) for c in centre))
    return x - np.array(centre, np.int64) if top < LONG // 2 else x.astype(object) - np.array(centre, object)


def merged(parts: DataFrame) -> list | None:
    """The sum of (part long, body string) over all rows, bodies being JSON lists of numbers of one shape.
    Matrices are added in groups of FAN_IN in the order of their parts, in as many rounds as that takes."""
    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("body").to_pylist()))
        total = [0] * len(json.loads(rows[0][1]))
        for _, body in rows:
            total = [a + b for a, b in zip(total, json.loads(body))]
        return pa.table({"part": pa.array([rows[0][0] // FAN_IN], pa.int64()), "body": pa.array([json.dumps(total)])})

    parts = stored(parts, "sums")
    left = parts.agg(F.max("part")).first()[0]
    if left is None:
        return None
    while left > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(add, "part long, body string")
        left //= FAN_IN
    return json.loads(parts.first()["body"])


def sums(rows: DataFrame, dim: int, of) -> list | None:
    """The sum of of(matrix of vectors) over a column `x` of packed vectors: a flat list of numbers."""
    def run(batches):
        total = None
        for b in batches:
            bodies = b.column(0).to_pylist()
            for at in range(0, len(bodies), BATCH):
                part = of(unpack(bodies[at:at + BATCH], dim))
                total = part if total is None else [p + q for p, q in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([json.dumps(total)])], names=["part", "body"])

    return merged(rows.select("x").mapInArrow(run, "part long, body string"))


def clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Groups of two or more neighbouring values that are at most width apart."""
    order = values.argsort()
    cut = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray):
    """Eigenvalues and eigenvectors of the symmetric a (extended precision) from the rough eigenvectors x."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    one, size = np.eye(len(a), dtype=np.longdouble), np.sqrt((a * a).sum())
    tiny = np.finfo(np.longdouble).eps * len(a)
    best = None
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding must not be divided by a gap on one side only
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(e)
        error = np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())
        if best is None or error < best[0]:
            best, idle = (error, e, x), 0
        else:
            idle += 1
        if error <= tiny * size / 8 or idle == 3:
            break
        width = max(2 * error, CLOSE * size)
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= width
        x = x + x @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
        for group in clusters(e, width):
            y = x[:, group]
            small = y.T @ (a @ y - e[group].mean() * y)
            top = np.abs(small).max()
            if top > 0:
                turn = np.linalg.eigh(((small + small.T) / (2 * top)).astype(np.float64))[1].astype(np.longdouble)
                x[:, group] = y @ (turn + turn @ (np.eye(len(group)) - turn.T @ turn) / 2)
    return best[1], best[2]


def principal(numerators: list[list[int]], denominator: int):
    """(eigenvalues falling, eigenvectors as columns, trace) of the exact matrix numerators / denominator, in
    double precision. The largest entry of a vector, the first of equal ones, is positive."""
    d = len(numerators)
    trace = Fraction(sum(numerators[i][i] for i in range(d)), denominator)
    if not trace:
        return np.zeros(d), np.eye(d), 0.0
    a = np.empty((d, d), np.longdouble)
    for i in range(d):
        for j in range(d):
            exact = Fraction(numerators[i][j], denominator) / trace
            head = float(exact)
            a[i, j] = np.longdouble(head) + np.longdouble(float(exact - Fraction(head)))
    e, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    order = np.argsort(-e, kind="stable")
    e, x = e[order], x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    x = x * np.sign(x[np.abs(x.astype(np.float64)).argmax(0), np.arange(d)])
    return (e * np.longdouble(float(trace))).astype(np.float64), x.astype(np.float64), float(trace)


def deviations(y: np.ndarray) -> list:
    """Exact sums of squares of integer rows; null where a long cannot hold one."""
    if y.dtype != object:
        rough = (y.astype(np.float64) ** 2).sum(1)
        if rough.max(initial=0) < 2.0 ** 62:
            return (y * y).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v < LONG else None for v in exact]


def scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly."""
    top = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, total))
    if top < LONG:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def whiten(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", scale: int = 256, count: int = 4) -> DataFrame:
    """One row per usable input row and component: id, component (from 1, by falling eigenvalue), n (distinct integer
    vectors), deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold null or non-finite entries or have another length than most (ties: the shorter)
    are dropped. An entry c becomes floor(scale * c), at the ends of a long where it does not fit. deviation is the sum
    over dimensions of (n*x - S)^2, null where a long cannot hold it. With fewer dimensions than `count` there
    are as many components. A component without variance (one distinct vector, constant or dependent dimensions)
    has whitened null and explained 0 up to rounding and is left out of identity_error, which is null if none is left.
    Repeated rows and null ids are rows like others; equal vectors get equal values. Eigenvectors of equal eigenvalues
    are one of their orthonormal bases. A table without usable rows gives no rows.
    """
    spark = df.sparkSession
    e = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), e.alias("e")).filter(
        F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("e") > 0))
    usual = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], OUT)
    dim = usual["d"]

    def packed(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                f = np.floor(flat * float(scale))
            whole = np.clip(f, -float(LONG), float(LONG - 1024)).astype(np.int64)
            whole[f >= float(LONG)] = LONG - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(whole, dim), pa.binary())], names=["id", "x"])

    rows = rows.filter(F.size("e") == dim).mapInArrow(packed, "id long, x binary")
    fit = stored(rows.select("x").distinct(), "fit-list")
    n, *total = sums(fit, dim, lambda x: [len(x), *(int(v) for v in x.astype(object).sum(0))])
    centre, rest = [t // n for t in total], [t % n for t in total]
    gram = sums(fit, dim, lambda x: product(minus(x, centre)).ravel().tolist())
    exact = [[n * gram[i * dim + j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    values, vectors, trace = principal(exact, n * n)
    k = min(count, dim)
    live = [i for i in range(k) if trace and values[i] > trace * dim * 2.0 ** -56]
    turn = vectors[:, live] / np.sqrt(values[live])
    share = [float(v / trace) if trace else 0.0 for v in values[:k]]

    def white(y):
        return (y.astype(np.float64) / n) @ turn

    def moments(x):
        w = white(scaled(x, n, total))
        return [*w.sum(0).tolist(), *(w.T @ w).ravel().tolist()]

    error = None
    if live:
        m = sums(fit, dim, moments)
        mean, second = np.array(m[:len(live)]) / n, np.array(m[len(live):]).reshape(len(live), -1) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(live))).max())
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def projected(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                ids, bodies = (b.column(c).slice(at, BATCH).to_pylist() for c in (0, 1))
                y = scaled(unpack(bodies, dim), n, total)
                far, w = deviations(y), white(y)
                columns = [[], [], [], [], [], [], []]
                for c in range(k):
                    here = w[:, live.index(c)].tolist() if c in live else [None] * len(ids)
                    for column, part in zip(columns, (ids, [c + 1] * len(ids), [n] * len(ids), far, here,
                                                      [share[c]] * len(ids), [error] * len(ids))):
                        column += part
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(projected, OUT)
