"""Operator 8, embedding near-duplicates through an inverted multi-index.

Two codebooks, fitted on the halves of a bounded sample of the vectors, form a product grid; each
vector lies in the cell of its nearest pair of centroids. A query visits cells by growing sum of its
two distances (multi-sequence order) until the target recall, turned into a number of cells on the
sample, and every vector in a visited cell is verified in double precision.

Every vector is indexed and every vector is a query. Equal vectors are one class with a weight. Rows
are dealt by the first half's centroid; crowded centroids are cut into blocks on both sides, so no
task holds more than a block of either. A task gives back one row per vector, its links and the
least vector it hangs together with, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SAMPLE = 8192  # vectors that the codebooks and the number of visits are fitted on
CENTROIDS = 512  # at most, in each codebook
BLOCK_BYTES = 16 << 20
EDGE = 2000  # pairs at the threshold that the number of visits is fitted on, beside the sample's own
CELLS = 1 << 22  # similarities held at once


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :])


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly taken starting points; a centroid without members stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Grid:
    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        half = sample.shape[1] // 2
        self.half, self.k, self.cosine = half, k, cosine
        self.books = codebook(sample[:, :half], k), codebook(sample[:, half:], k)
        self.visits = self.fit_visits(sample, recall)

    def halves(self, x):
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of the multi-sequence order, nearest first: (rows, visits). The cell of the
        i-th and j-th nearest centroids has (i+1)(j+1)-1 cells before it at least, which bounds the
        frontier."""
        a, b = self.halves(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i = np.concatenate([np.full(min(self.k, visits // (r + 1)), r) for r in range(min(self.k, visits))])
        j = np.concatenate([np.arange(min(self.k, visits // (r + 1))) for r in range(min(self.k, visits))])
        total = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        first = total.argsort(1, kind="stable")[:, :visits]
        return np.take_along_axis(ia, i[first], 1) * self.k + np.take_along_axis(ib, j[first], 1)

    def fit_visits(self, sample: np.ndarray, recall: float) -> int:
        """The least number of visits that finds the target share of pairs from either end, both of the sample's vectors with
        their least similar partner and of pairs at the very threshold in random directions: a vector counts
        once, however many partners a crowd gives it, and near-equal vectors don't speak for those at the threshold."""
        a, b = [], []
        for at in range(0, len(sample), 1024):
            c = sample[at:at + 1024] @ sample.T
            rows = np.arange(len(c))
            c[rows, at + rows] = -2
            c[c < self.cosine] = 2
            j = c.argmin(1)
            some = c[rows, j] < 2
            a.append(at + rows[some])
            b.append(j[some])
        a, b = np.concatenate(a), np.concatenate(b)
        rng = np.random.default_rng(7)
        z = sample[np.linspace(0, len(sample) - 1, EDGE).astype(int)]
        r = rng.standard_normal(z.shape)
        r = unit(r - (r * z).sum(1, keepdims=True) * z)
        edge = self.cosine * z + np.sqrt(1 - self.cosine ** 2) * r
        visits = 1
        for x, y in ((sample[a], sample[b]), (z, edge)):
            place = np.sort(np.minimum(self.places(x, y), self.places(y, x))) if len(x) else np.zeros(1)
            visits = max(visits, int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1)
        return visits

    def places(self, x, y) -> np.ndarray:
        """How many cells come before y's cell in x's order."""
        out, cell = [], self.cells(y)
        for at in range(0, len(x), 256):
            a, b = self.halves(x[at:at + 256])
            c = cell[at:at + 256]
            rows = np.arange(len(a))
            mine = a[rows, c // self.k] + b[rows, c % self.k]
            out.append(((a[:, :, None] + b[:, None, :]) < mine[:, None, None]).sum((1, 2)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def vectors_of(column, dim: int) -> np.ndarray:
    """Packed vectors as rows; 4 or 8 bytes a component, as they came."""
    body = b"".join(column.cast(pa.binary()).to_pylist())
    kind = "<f4" if len(body) == 4 * dim * len(column) else "<f8"
    return np.frombuffer(body, kind).reshape(-1, dim)


def _packed(dim: int, kind: str):
    def run(batches):
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary())],
                                             names=["uid", "w", "vec"])

    return run


def _routes(grid, dim: int, block: int, sides):
    """Each vector once for its own centroid (role 0) and once per first centroid among its visits (role
    1), with the block pair it meets in. sides: blocks of either role per centroid, None to count only."""
    names = ["c1", "block", "role", "uid", "w", "cell", "visits", "vec"]

    def run(batches):
        g = grid.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = unit(vectors_of(part.column(2), dim))
                own, seen = g.cells(x), g.order(x, g.visits)
                uid, w, vec = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                rows = []
                for i in range(len(x)):
                    first = own[i] // g.k
                    routes = [(int(first), 0, b"")]
                    heads = seen[i] // g.k
                    routes += [(int(h), 1, (seen[i][heads == h] % g.k).astype("<i4").tobytes()) for h in np.unique(heads)]
                    for c1, role, visits in routes:
                        if sides is None:
                            rows.append((c1, 0, role, uid[i], w[i], 0, b"", b""))
                            continue
                        mine, other = sides[role][c1], sides[1 - role][c1]
                        at_ = uid[i] * 2654435761 % 4294967296 % mine
                        for o in range(other):
                            p, q = (at_, o) if role == 0 else (o, at_)
                            rows.append((c1, p * sides[1][c1] + q, role, uid[i], w[i], int(own[i]), visits, vec[i]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    return run


ROUTE = "c1 long, block long, role long, uid long, w long, cell long, visits binary, vec binary"


def _verify(grid, dim: int):
    def run(table: pa.Table) -> pa.Table:
        g = grid.value
        role, uid, w, cell = (table.column(n).to_numpy() for n in ("role", "uid", "w", "cell"))
        x = unit(vectors_of(table.column("vec").combine_chunks(), dim))
        index, query = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        column = cell[index] % g.k
        asked = {}
        visits = table.column("visits").to_pylist()
        for q in query:
            for c in np.frombuffer(visits[q], "<i4").tolist():
                asked.setdefault(c, []).append(q)
        ids, node = np.unique(uid, return_inverse=True)
        root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        touched = np.zeros(len(ids), bool)
        for c in np.unique(column).tolist():
            if c not in asked:
                continue
            inside, who = index[column == c], np.array(asked[c])
            step = max(1, CELLS // len(inside))
            for at in range(0, len(who), step):
                part = who[at:at + step]
                a, b = np.nonzero(x[part] @ x[inside].T >= g.cosine)
                a, b = part[a], inside[b]
                apart = uid[a] != uid[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                np.add.at(links, node[a], w[b])
                hit = np.unique(b)  # those that do not come across the query themselves
                cells = np.unique(cell[a])
                seen = g.order(x[hit], g.visits)
                meets = np.stack([(seen == u).any(1) for u in cells], 1)
                alone = ~meets[np.searchsorted(hit, b), np.searchsorted(cells, cell[a])]
                np.add.at(links, node[b[alone]], w[a[alone]])
                a, b = node[a], node[b]
                touched[a] = touched[b] = True
                while len(a):  # least label over the links of this step; the pairs are not kept
                    p, q = root[a], root[b]
                    apart = p != q
                    a, b, p, q = a[apart], b[apart], p[apart], q[apart]
                    np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                    while (root[root] != root).any():
                        root = root[root]
        return pa.table({"uid": pa.array(ids[touched], pa.int64()), "n": pa.array(links[touched]), "root": pa.array(ids[root[touched]], pa.int64())})

    return run


def near_duplicates(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, recall: float = 0.99,
                    salts: int = 16) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows whose cosine is at least `cosine`, as far as the index finds them;
    component_id is the least id reachable. Vectors that are null, empty, zero, hold null or
    non-finite components, or have another length than most, link with nothing and are components by
    themselves. Rows with equal vectors link with each other. Null ids are passed over in
    component_id; `kept` is id = component_id, true for a lone row without an id.
    """
    spark = df.sparkSession
    e = F.col(f"`{vector}`")
    single = df.schema[vector].dataType.elementType.typeName() == "float"
    clean = F.transform(e, lambda v: v.cast("float" if single else "double") + F.lit(0.0).cast("float"))
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), clean.alias("e"))
    good = F.coalesce(F.col("e").isNotNull() & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.select("id", "e", good.alias("good"))
    sizes = rows.filter("good and size(e) > 1").groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "d").first()
    if usual is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = usual["d"]
    keys = [F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(7), "e").alias("h2")]
    rows = rows.withColumn("good", F.col("good") & (F.size("e") == dim)).select("id", "good", "e", *keys)
    classes = stored(rows.filter("good").groupBy("e").agg(F.min("id").alias("low"), F.count("*").alias("w"), F.first("h1").alias("h1"),
                                                          F.first("h2").alias("h2")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    packed = classes.select("uid", "w", "e").mapInArrow(_packed(dim, "<f4" if single else "<f8"), "uid long, w long, vec binary")
    sample = packed.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow()
    x = unit(vectors_of(sample.column("vec").combine_chunks(), dim))
    k = int(min(CENTROIDS, len(x), max(2, np.sqrt(classes.count() / 16))))
    grid = spark.sparkContext.broadcast(Grid(x, k, cosine, recall))

    block = max(256, BLOCK_BYTES // (8 * dim))
    tally = packed.mapInArrow(_routes(grid, dim, block, None), ROUTE).groupBy("c1", "role").agg(F.count("*").alias("n"))
    sides = [[1] * k, [1] * k]
    for r in tally.collect():  # two rows per centroid at most
        sides[r.role][r.c1] = -(-r.n // block)
    met = packed.mapInArrow(_routes(grid, dim, block, sides), ROUTE).groupBy("c1", "block").applyInArrow(
        _verify(grid, dim), "uid long, n long, root long")
    met = stored(met, "vector-links")
    links = met.groupBy("uid").agg(F.sum("n").alias("n"))
    roots = components(met.select(F.col("uid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("uid"), "root")

    placed = classes.select("uid", "low", "w", "h1", "h2").join(links, "uid", "left").join(roots, "uid", "left").withColumn(
        "root", F.coalesce("root", "uid"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = placed.join(least, "root").select("h1", "h2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id",
                                               F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = rows.filter("good").select("id", "h1", "h2", F.pmod(F.hash("id"), F.lit(salts)).alias("salt"))
    found = asked.join(answer, ["h1", "h2", "salt"]).select("id", "n_links", "component_id")
    lone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
