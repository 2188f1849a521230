"""Operator 9, n-gram Jaccard self-join by vertical partitioning, reported as components.

All distinct n-grams have one global order, rare ones first (count of the n-gram's bucket, then its
64-bit hash). The order is cut into fragments of equal mass, and each document's set into the
segments that fall into them; a pair's overlap is counted fragment by fragment and summed.

Which pairs to count:
* Equal sets meet by digest and are one set from then on within a partition. Those of different partitions are linked by
  digest too; pairs are of their first ones only, so no overlap of equal sets is counted.
* No row stays in a bucket unless sizes and positions allow it some partner there.
* No pair's sets are fetched unless the pair's parity signatures allow the overlap it needs.
* Sets with Jaccard >= t share one of their rarest |x| - ceil(t|x|) + 1 n-grams. The sets of such an
  n-gram form a bucket, and every set of it is first compared to one pivot (its least), so a bucket
  gives as many pairs as it has sets. Sizes and positions rule most of them out beforehand.
* After the components of these links, only pairs of a bucket that lie in different components are
  left to compare. They are cut down by size, by position and, as 1 - Jaccard is a metric, by the
  two distances to the pivot. Large buckets are compared in blocks, in rounds: in the first a set gives its one most
  alike partner of a block, then, where more were left, four, sixteen and so on; each round's links join components
  before the next, so a large family of near copies is one component after a few rounds and gives no more pairs. The
  rounds end when no set had more partners than were tested.
The components are exact, though not every link inside a component is ever looked at.

Hot buckets are dealt over salts, each with a pivot of its own, and the pivots meet once more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Combiner, columns, pieces, stored
from .components import components

SETS = "key long, digest binary, n long, min_id long, ids array<long>, body binary, sig array<long>, counts array<long>"
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
BLOCK = 4096  # sets of a bucket that are compared at once
HOT = 8192  # n-grams counted in a bucket from which it is dealt over salts


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, lower-casing A-Z; words are what
    stands between ASCII white space. A text with fewer words is one n-gram, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i:i + len(out)]) * np.uint64(MIX[i % 5])
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray) -> list[int]:
    """Parities of 1,024 groups of n-grams. Two sets differ in at least as many n-grams as their
    signatures differ in bits, which rules a pair out without its sets."""
    odd = np.bincount(((grams >> np.uint64(20)) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(n: int, bits: int, max_bytes: int):
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("min_id", pa.int64()),
                        ("ids", pa.list_(pa.int64())), ("body", pa.binary()), ("sig", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64()))])

    def run(batches):
        base, made, counts = TaskContext.get().partitionId() << 40, 0, np.zeros(1 << bits, np.int64)
        pack = zstandard.ZstdCompressor(level=3).compress
        groups, bodies, held, seen = Combiner(lambda b: b, max_bytes), {}, 0, []

        def flush():
            nonlocal made, bodies, held
            rows = list(groups.take())
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                keys = list(range(base + made, base + made + len(part)))
                made += len(part)
                known = [[x for x in ids if x is not None] for _, _, ids in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([
                    keys, [d for d, _, _ in part], [bodies[d][0] for d, _, _ in part],
                    [min(k) if k else None for k in known], [ids for _, _, ids in part],
                    [bodies[d][1] for d, _, _ in part], [bodies[d][2] for d, _, _ in part], [None] * len(part)], schema)], schema=schema)
            bodies, held = {}, 0

        for b in pieces(batches, 4 << 20):
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = ngrams(text, n)
                d = hashlib.sha256(grams.tobytes()).digest()
                full = groups.add(row_id, d)
                if d not in bodies:
                    bodies[d] = (len(grams), pack(text.encode("utf-8", "surrogatepass")), signature(grams))
                    held += len(bodies[d][1])
                    seen.append(grams >> np.uint64(64 - bits))
                if full or held > max_bytes:
                    yield from flush()
            if seen:
                counts += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(counts))
                seen.clear()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
            [None, None, None, None, None, None, None, counts], schema)], schema=schema)

    return run


class Order:
    """The global order: rank of a bucket of n-grams, its fragment, and how many salts it needs.
    The table has 2^bits entries whatever the corpus holds."""

    def __init__(self, counts: np.ndarray, bits: int, fragments: int):
        self.shift, self.counts = np.uint64(64 - bits), counts
        by = np.argsort(counts, kind="stable")
        mass = np.cumsum(counts[by])
        self.fragment = np.empty(len(counts), np.int32)
        self.fragment[by] = np.minimum(fragments - 1, mass * fragments // max(1, mass[-1] + 1))
        usual = 2 * counts.sum() // len(counts)
        self.salts = 1 + np.maximum(0, counts - usual) // HOT

    def bucket(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> self.shift).astype(np.int64)

    def sort(self, grams: np.ndarray) -> np.ndarray:
        return grams[np.lexsort((grams, self.counts[self.bucket(grams)]))]


def needed(n, num: int, den: int):
    """ceil(n * num / den)"""
    return -(-n * num // den)


def _prefixes(order, n: int, num: int, den: int):
    names = ["gram", "salt", "salts", "key", "n", "pos"]

    def run(batches):
        o = order.value
        for b in pieces(batches, 1 << 20):
            cols = [[] for _ in names]
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = ngrams(zstandard.decompress(body).decode("utf-8", "surrogatepass"), n)
                size = len(grams)
                first = o.sort(grams)[:size - needed(size, num, den) + 1]
                salts = o.salts[o.bucket(first)]
                for c, x in zip(cols, (first.view(np.int64), (key * 40503 + (key >> 40)) % salts, salts, np.full(len(first), key),
                                       np.full(len(first), size), np.arange(len(first)))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=names)

    return run


def runs(batches, keys: int):
    """Rows sorted by the first `keys` columns as one 2-d array per group, across batches."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
        cut = np.flatnonzero((x[1:, :keys] != x[:-1, :keys]).any(axis=1)) + 1
        parts = np.split(x, cut)
        if held and (held[-1][0, :keys] == parts[0][0, :keys]).all():
            held.append(parts.pop(0))
            if not parts:
                continue
        if held:
            yield np.concatenate(held)
        yield from parts[:-1]
        held = [parts[-1]]
    if held:
        yield np.concatenate(held)


def _partnered(x: np.ndarray, num: int, den: int, most: int = 64) -> np.ndarray:
    """The rows of sorted (gram, salt, salts, key, n, pos) that have a partner in their group by `_may_link`. Rows of the first
    and the last group, which may go on in other batches, and of dealt n-grams stay, and so do rows with more than `most`
    rows of their size beside them."""
    group = np.cumsum(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)])
    keep = (x[:, 2] > 1) | (group == group[0]) | (group == group[-1])
    by = np.lexsort((x[:, 4], group))
    g, n, left = group[by], x[by, 4], x[by, 4] - x[by, 5]
    at = np.arange(len(x))
    for apart in range(1, most + 2):  # rows of a group in order of size: who is too small for one is too small for all after it
        at = at[at + apart < len(x)]
        to = at + apart
        near = (g[at] == g[to]) & (n[at] * den >= n[to] * num)
        at, to = at[near], to[near]
        if not len(at):
            break
        fits = (np.minimum(left[at], left[to]) * (num + den) >= (n[at] + n[to]) * num) | (apart > most)
        keep[by[at[fits]]] = keep[by[to[fits]]] = True
    return x[keep]


def _pivots(num: int, den: int):
    """Marks each row of sorted (gram, salt, salts, key, n, pos) with the first row of its group and
    drops groups of one and rows without a partner. Holds one row between batches, whatever a group's size."""

    def run(batches):
        yield from _mark_pivots(_partnered(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]), num, den)
                                for b in batches if b.num_rows)

    return run


def _mark_pivots(parts):
    names = ["gram", "salts", "key", "n", "pos", "pivot", "pivot_n", "pivot_pos"]
    last, waiting = None, False  # the open group's first row, and whether it is still alone
    for x in parts:
        if last is not None:
            x = np.concatenate([last[None, :], x])
        new = np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]
        group = np.cumsum(new) - 1
        first = x[np.flatnonzero(new)][group]
        size = np.bincount(group)
        keep = (size[group] > 1) | (x[:, 2] > 1)
        if last is not None:
            keep[0] &= waiting  # it was put out before
        open_ = group == group[-1]
        waiting_next = (size[-1] == 1) and (last is None or group[-1] > 0 or waiting)
        if waiting_next:
            keep[open_] = False
        last, waiting = first[-1].copy(), waiting_next
        y, p = x[keep], first[keep]
        if len(y):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (y[:, 0], y[:, 2], y[:, 3], y[:, 4], y[:, 5], p[:, 3], p[:, 4], p[:, 5])], names=names)
    if waiting and last[2] > 1:
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (
            last[0], last[2], last[3], last[4], last[5], last[3], last[4], last[5])], names=names)


def _may_link(n1, p1, n2, p2, num: int, den: int):
    """Sizes within the threshold, and enough n-grams left after the shared one for the overlap that
    num/den asks for. Sound where the shared n-gram is the first that the pair shares."""
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    left = 1 + F.least(n1 - p1, n2 - p2) - 1
    return (low * den >= high * num) & (left * (num + den) >= (n1 + n2) * num)


def _segments(order, n: int):
    def run(batches):
        o = order.value
        for b in pieces(batches, 1 << 20):
            keys, frags, segs = [], [], []
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = ngrams(zstandard.decompress(body).decode("utf-8", "surrogatepass"), n)
                f = o.fragment[o.bucket(grams)]
                for i in np.unique(f).tolist():
                    keys.append(key)
                    frags.append(i)
                    segs.append(grams[f == i].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(frags, pa.int32()), pa.array(segs, pa.binary())],
                                             names=["key", "frag", "seg"])

    return run


def _shared(batches):
    for b in batches:
        left, right = b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()
        hits = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.int64())], names=["a", "b", "hits"])


def overlaps(pairs: DataFrame, sets: DataFrame, order, n: int, fragments: int) -> DataFrame:
    """(a, b, hits): the number of n-grams that the sets of each pair share, summed over fragments."""

    def segs(end, name):
        ends = pairs.select(F.col(end).alias("key")).distinct()
        cut = sets.select("key", "body").join(ends, "key").mapInArrow(_segments(order, n), "key long, frag int, seg binary")
        return cut.select(F.col("key").alias(end), "frag", F.col("seg").alias(name))

    wide = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("frag"))
    met = wide.join(segs("a", "x"), ["a", "frag"]).join(segs("b", "y"), ["b", "frag"]).select("a", "b", "x", "y")
    return met.mapInArrow(_shared, "a long, b long, hits long").groupBy("a", "b").agg(F.sum("hits").alias("hits"))


def _across(num: int, den: int, most: int):
    """Pairs of a block pair (gram, lo, hi, block, key, n, pos, root, pivot, hits, pivot_n, signature) that lie
    in different components and that sizes, positions, signatures and distances to the pivot don't
    rule out: of each set the `most` whose signatures are nearest, and whether there are more."""

    def run(batches):
        for x in runs(batches, 3):
            lo, hi, block = x[0, 1], x[0, 2], x[:, 3]
            left, right = x[block == lo], x[block == hi]
            for i in range(0, len(left), 512):
                p = left[i:i + 512, None, :]
                q = right[None, :, :]
                n1, n2 = p[..., 5], q[..., 5]
                ok = (p[..., 7] != q[..., 7]) & (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num)
                ok &= np.minimum(n1 - p[..., 6], n2 - q[..., 6]) * (num + den) >= (n1 + n2) * num
                if lo == hi:
                    ok &= p[..., 4] < q[..., 4]
                first, second = np.nonzero(ok)
                kept = []
                for j in range(0, len(first), 100_000):
                    at, to = first[j:j + 100_000], second[j:j + 100_000]
                    a, b = left[i + at], right[to]
                    n = a[:, 5] + b[:, 5]
                    differ = np.bitwise_count((a[:, 11:] ^ b[:, 11:]).view(np.uint64)).sum(1).astype(np.int64)
                    near = differ <= n - 2 * needed(n, num, num + den)
                    far = [np.where(z[:, 9] < 0, np.nan, 1 - z[:, 9] / np.maximum(1, z[:, 5] + z[:, 10] - z[:, 9])) for z in (a, b)]
                    near &= ~((a[:, 8] == b[:, 8]) & (np.abs(far[0] - far[1]) > 1 - num / den + 1e-9))
                    kept.append(np.stack([at, differ, to])[:, near])
                if not kept or not sum(k.shape[1] for k in kept):
                    continue
                at, differ, to = np.concatenate(kept, 1)
                by = np.lexsort((to, differ, at))
                at, to = at[by], to[by]
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                count = np.diff(np.r_[start, len(at)])
                take = np.arange(len(at)) - np.repeat(start, count) < most
                a, b, more = left[i + at[take], 4], right[to[take], 4], np.repeat(count > most, count)[take]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), x[0, 0])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)),
                                                  pa.array(more)], names=["gram", "a", "b", "more"])

    return run


def ngram_components(df: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100,
                     fragments: int = 8, bits: int = 18, max_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id, n_grams, component_id, kept.

    Rows link when the Jaccard similarity of their n-gram sets is at least num/den. component_id is
    the least id reachable by links, its own included; null ids are passed over, and a component
    of null ids only has none. A null, empty or blank text has no n-grams, links with nothing and
    is a component by itself. Repeated rows link like other equal texts. `kept` marks the row
    that gives its component the id (each of them, should several rows share that id) and every
    row without an id.
    Overlaps are counted on 64-bit hashes of the n-grams.
    """
    spark = df.sparkSession
    sets = stored(columns(df, row_id, text).mapInArrow(_sets(n, bits, max_bytes), SETS), "ngram-sets")
    tally = sets.filter("key is null").select(F.posexplode("counts").alias("i", "c")).filter("c > 0").groupBy("i").agg(F.sum("c").alias("c"))
    counts = np.zeros(1 << bits, np.int64)  # at most 2^bits rows come back
    found = tally.toArrow()
    counts[found.column("i").to_numpy()] = found.column("c").to_numpy()
    order = spark.sparkContext.broadcast(Order(counts, bits, fragments))
    sets = sets.filter("key is not null")
    full = sets.filter("n > 0")

    prefix = full.select("key", "body").mapInArrow(
        _prefixes(order, n, num, den), "gram long, salt long, salts long, key long, n long, pos long")
    buckets = stored(prefix.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "key").mapInArrow(
        _pivots(num, den), "gram long, salts long, key long, n long, pos long, pivot long, pivot_n long, pivot_pos long"), "ngram-buckets")
    size = (F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"))
    stars = buckets.filter((F.col("key") != F.col("pivot")) & _may_link(*size, num, den)).select("pivot", "key")
    tops = buckets.filter("salts > 1 and key = pivot").select("gram", F.struct("key", "n", "pos").alias("p"))
    heads = tops.join(tops.groupBy("gram").agg(F.min("p").alias("top")), "gram").filter("p.key != top.key").filter(
        _may_link(F.col("p.n"), F.col("p.pos"), F.col("top.n"), F.col("top.pos"), num, den)).select(
        F.col("top.key").alias("pivot"), F.col("p.key").alias("key"))
    same = stored(full.groupBy("digest").agg(F.min("key").alias("a"), F.collect_list("key").alias("all")).select(
        "a", F.explode("all").alias("b")).filter("a != b"), "ngram-same")
    # only sets of buckets are ever compared
    marks = stored(full.select("key", "n", "sig").join(buckets.select("key").distinct(), "key", "left_semi"), "ngram-marks")
    sizes = marks.select("key", "n")

    def of_first(pairs):
        """Each end as the first of the sets equal to it, which lies in the same buckets; pairs of equal sets are left out."""
        for end in "ab":
            first = same.select(F.col("a").alias("first"), F.col("b").alias(end))
            pairs = pairs.join(first, end, "left").withColumn(end, F.coalesce("first", end)).drop("first")
        return pairs.filter("a != b").select("a", "b").distinct()

    def not_apart(pairs, name, sig):
        """Pairs whose signatures allow the overlap they need; only (a, b) and one signature of a pair are shuffled."""
        left, right = (marks.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), sig.alias(f"{name}{k}")) for k in "ab")
        differ = F.aggregate(F.zip_with(f"{name}a", f"{name}b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
        least = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
        return pairs.join(left, "a").join(right, "b").filter(differ <= F.col("na") + F.col("nb") - 2 * least).select("a", "b")

    def plausible(pairs):
        """First by 128 bits, parities of eight groups each, which settles most pairs of unlike sets; then by all 1,024."""
        short = F.array(*[F.expr(" ^ ".join(f"sig[{i}]" for i in range(h, 16, 2))) for h in (0, 1)])
        return not_apart(not_apart(pairs, "h", short), "s", F.col("sig"))

    star_pairs = stored(plausible(of_first(stars.union(heads).distinct().select(F.col("pivot").alias("a"), F.col("key").alias("b")))), "ngram-pairs")

    def linked(hits):
        both = hits.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(
            sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
        return both.filter(F.col("hits") * den >= (F.col("na") + F.col("nb") - F.col("hits")) * num).select("a", "b")

    star_hits = stored(overlaps(star_pairs, full, order, n, fragments), "ngram-hits")
    roots = stored(components(linked(star_hits).unionByName(same)), "ngram-roots")

    known = star_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    grams, most = buckets.select("gram").distinct(), 1
    while True:
        of_key = roots.join(same.select(F.col("b").alias("node"), F.lit(True).alias("again")), "node", "left").withColumnRenamed("node", "key")
        rows = buckets.join(grams, "gram", "left_semi").join(of_key, "key", "left").filter("again is null").withColumn(
            "root", F.coalesce("root", "key"))
        open_ = rows.groupBy("gram").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("rows")).filter(
            "r1 != r2 and rows > 2")
        left = rows.join(open_.select("gram", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks")), "gram").join(
            star_hits.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "hits"), ["pivot", "key"], "left").join(
            marks.select("key", "sig"), "key")
        block = F.pmod(F.xxhash64("key"), F.col("blocks"))
        dealt = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "n",
                             "pos", "root", "pivot", F.coalesce("hits", F.lit(-1)).alias("hits"), "pivot_n",
                             *[F.col("sig")[i].alias(f"s{i}") for i in range(16)])
        found = stored(dealt.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi").mapInArrow(
            _across(num, den, most), "gram long, a long, b long, more boolean"), "ngram-found")
        rest = stored(found.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "ngram-rest")
        if not rest.isEmpty():
            more = linked(overlaps(rest, full, order, n, fragments))
            roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "ngram-roots")
            known = known.unionByName(rest)
        grams = found.filter("more").select("gram").distinct()
        if grams.isEmpty():
            break
        most *= 4

    placed = full.select("key", "n", "min_id", "ids").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("min_id").alias("component_id"))
    linked_rows = placed.join(least, "root").select(F.explode("ids").alias("id"), F.col("n").alias("n_grams"), "component_id")
    bare = sets.filter("n = 0").select(F.explode("ids").alias("id"), F.col("n").alias("n_grams")).withColumn("component_id", F.col("id"))
    return linked_rows.unionByName(bare).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
