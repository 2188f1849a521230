"""Operator 11, periodic runs of words: every stretch that repeats with a period, found through suffix trees.

A run has a Lyndon root: of the longest Lyndon words that start at each place, in one of the two orders
of the words, one is a period of the run (the runs theorem). So each place gives two candidates,
which are extended to the right by the longest common extension (LCE) of two suffixes and to the left by that
of two prefixes. LCEs are depths of lowest common ancestors in Ukkonen's suffix trees of the words and
of their reversal, answered in constant time as minima over the Euler tour. Lyndon words end at the next smaller
suffix, in the leaf order of the same tree.

Only stretches that can hold a run get trees. In a run of at least `least` >= 6 words and four periods each word
stands four times and every four consecutive words twice, so a text is cut where four words
stand only once, until nothing changes; no run is lost or shortened. Work and memory are linear
in the words, a few hundred bytes for each word of the longest stretch.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GRAM = 4  # consecutive words that a run must hold twice
BLOCK = 16  # tour entries in a block of the range minimum


def ukkonen(s: list[int], width: int):
    """The suffix tree of s, whose last symbol stands nowhere else: start and end of each node's edge
    label, and the edges as {node * width + symbol: child}."""
    n = len(s)
    start, end, link, edge = [0], [0], [0], {}
    node = at = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                at = i
            key = node * width + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                start.append(i), end.append(n), link.append(0)
                if last:
                    link[last], last = node, 0
            else:
                a, b = start[child], end[child]
                span = (b if b <= i else i + 1) - a
                if length >= span:
                    at, length, node = at + span, length - span, child
                    continue
                if s[a + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                mid = edge[key] = len(start)
                start.append(a), end.append(a + length), link.append(0)
                edge[mid * width + c] = mid + 1
                start.append(i), end.append(n), link.append(0)
                start[child] = a + length
                edge[mid * width + s[a + length]] = child
                if last:
                    link[last] = mid
                last = mid
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length, at = length - 1, i - waiting + 1
    return start, end, edge


class Minimum:
    """Least value of any range in constant time: minima from both ends of each block, doubled ranges of blocks."""

    def __init__(self, values: np.ndarray):
        short = -len(values) % BLOCK
        rows = np.pad(values, (0, short), constant_values=np.iinfo(values.dtype).max).reshape(-1, BLOCK)
        self.flat = rows.ravel()
        self.head = np.minimum.accumulate(rows, 1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [rows.min(1)]
        while 2 << (len(self.levels) - 1) <= len(rows):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.minimum(a, b), np.maximum(a, b)
        p, q = a // BLOCK, b // BLOCK
        out = np.minimum(self.tail[a], self.head[b])
        same = np.flatnonzero(p == q)
        if len(same):
            x, y, least = a[same], b[same], self.flat[a[same]]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.flat[np.minimum(x + k, y)])
            out[same] = least
        wide = np.flatnonzero(q - p > 1)
        if len(wide):
            p, q = p[wide] + 1, q[wide]
            level = np.frexp((q - p).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                here = level == k
                w = wide[here]
                low = self.levels[k]
                out[w] = np.minimum(out[w], np.minimum(low[p[here]], low[q[here] - (1 << k)]))
        return out


class Tree:
    """The suffix tree of a sequence of words >= 1, with LCE queries and the leaf orders."""

    def __init__(self, words: list[int], width: int):
        s = words + [0]
        self.n = len(s)
        start, end, edge = ukkonen(s, width)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        order = keys.argsort()
        keys = keys[order]
        self.child = np.fromiter(edge.values(), np.int64, len(edge))[order].tolist()
        self.bound = np.searchsorted(keys // width, np.arange(len(start) + 1)).tolist()
        self.ended = (keys % width == 0).tolist()
        del edge, keys, order
        self._tour(start, end)

    def _tour(self, start, end):
        child, bound = self.child, self.bound
        nodes = len(start)
        place, up, depth, turn = [0] * nodes, [0] * nodes, [0] * nodes, bound[:nodes]
        tour, leaves, v = [0], [], 0
        while True:
            k = turn[v]
            if k < bound[v + 1]:
                turn[v] = k + 1
                c = child[k]
                up[c], depth[c], place[c] = v, depth[v] + end[c] - start[c], len(tour)
                tour.append(depth[c])
                if bound[c] == bound[c + 1]:
                    leaves.append(c)
                    tour.append(depth[v])
                else:
                    v = c
            elif v:
                v = up[v]
                tour.append(depth[v])
            else:
                break
        self.leaves = np.array(leaves)
        self.suffix = self.n - np.array(depth)  # of a leaf: where its suffix starts
        self.place = np.empty(self.n, np.int64)
        self.place[self.suffix[self.leaves]] = np.array(place)[self.leaves]
        self.least = Minimum(np.array(tour, np.int64))

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at a and b, different places."""
        return self.least(self.place[a], self.place[b])

    def ranks(self, rising: bool) -> list[int]:
        """Rank of each suffix in the order of the words or its reverse; the end of the text is least in both."""
        leaves = self.leaves
        if not rising:
            child, bound, ended, stack, leaves = self.child, self.bound, self.ended, [0], []
            while stack:
                v = stack.pop()
                a, b = bound[v], bound[v + 1]
                if a == b:
                    leaves.append(v)
                elif ended[a]:
                    stack.extend(child[a + 1:b])
                    stack.append(child[a])
                else:
                    stack.extend(child[a:b])
            leaves = np.array(leaves)
        out = np.empty(self.n, np.int64)
        out[self.suffix[leaves]] = np.arange(self.n)
        return out.tolist()


def next_smaller(rank: list[int]) -> list[int]:
    """For each suffix but the last the next one of lower rank; between them lies its longest Lyndon word."""
    out, waiting = [0] * (len(rank) - 1), []
    for j, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return out


def tree_runs(words: list[int], width: int, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of a stretch."""
    m = len(words)
    tree = Tree(words, width)
    at, period = [], []
    for rising in (True, False):
        p = np.array(next_smaller(tree.ranks(rising))) - np.arange(m)
        i = np.flatnonzero(p * times <= m)
        at.append(i)
        period.append(p[i])
    i, p = np.concatenate(at), np.concatenate(period)
    right = tree.lce(i, i + p)
    del tree
    back = Tree(words[::-1], width)
    left = back.lce(m - i, m - i - p)
    length = left + p + right
    found = np.stack([i - left, length, p], 1)[length >= np.maximum(least, times * p)]
    return np.unique(found, axis=0)


def stretches(words: np.ndarray, least: int):
    """(from, to) of the parts that can hold a run: each GRAM of consecutive words stands twice in them."""
    open_ = [(0, len(words))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        x = words[a:b].astype(np.uint64)
        g = x[:b - a - GRAM + 1].copy()
        for k in range(1, GRAM):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
            g += x[k:b - a - GRAM + 1 + k]
        order = g.argsort()
        same = np.diff(g[order]) == 0
        twice = np.zeros(len(g) + 2, np.int8)
        twice[1 + order[1:][same]] = 1
        twice[1 + order[:-1][same]] = 1
        edge = np.diff(twice)
        parts = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        if parts == [(0, len(g))]:
            yield a, b
        else:
            open_ += [(a + i, a + j + GRAM - 1) for i, j in parts]


def find_runs(words: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of all runs of at least max(least, times * period)
    words that no neighbouring word extends. words: numbers that are equal for equal words; least >= 6, times >= 4."""
    if least < 6 or times < 4:
        raise ValueError("runs have at least 6 words and 4 periods")
    out = []
    for a, b in stretches(words, least):
        part, ids = np.unique(words[a:b], return_inverse=True)
        found = tree_runs((ids + 1).tolist(), len(part) + 1, least, times)
        out += [(a + s, n, p) for s, n, p in found.tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words: list[str], h: int) -> list[str]:
    """The words with a periodic tail if h is a multiple of ten, as the query's contract makes them."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


COLUMNS = ["id long", "n_runs long", "start long", "length long", "period long", "exponent_milli long", "runs_sha256 string",
           "collapsed_sha256 string"]


def periodic_runs(df: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4,
                  change=None, texts: bool = False) -> DataFrame:
    """One row per input row: id, n_runs, the longest run (start, length, period, exponent_milli; ties: least start, then
    period), runs_sha256 of all runs and collapsed_sha256 of the words that stay when of each run only the first
    period is kept, joined by spaces. texts: adds that collapsed text and runs, an array of (start, length, period).

    Words are runs of characters other than the ASCII blanks, compared as they stand. change(words, id)
    may give other words for the search. A null or empty text has no words and no run: its four columns are null and
    its digests those of the empty text. Repeated rows and null ids are rows like others. A text of any length is searched
    as a whole; its words all lie in one task. An empty table gives no rows.
    """
    fields = COLUMNS + (["collapsed string", "runs array<struct<start:long,length:long,period:long>>"] if texts else [])

    def row(doc, body):
        words = WORD.findall(body)
        if change:
            words = change(words, doc)
        known = {}
        numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        runs = find_runs(numbers, least, times)
        best, kept = (None,) * 4, words
        if runs:
            s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = s, n, p, 1000 * n // p
            step = np.zeros(len(words) + 1, np.int64)
            for s, n, p in runs:
                step[s + p] += 1
                step[s + n] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        collapsed = " ".join(kept)
        out = (doc, len(runs), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed)))
        return out + (collapsed, [dict(zip(("start", "length", "period"), r)) for r in runs]) if texts else out

    kinds = {"long": pa.int64(), "string": pa.string()}
    record = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = pa.schema([(f.split()[0], kinds.get(f.split()[1], record)) for f in fields])

    def run(batches):
        for b in pieces(batches, 4 << 20):
            rows = [row(*r) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return columns(df, row_id, text).mapInArrow(run, ", ".join(fields))


def contract_change(words, doc):
    """The change of the registered query: h is the CRC of the id's decimal form; a null id changes nothing."""
    return words if doc is None else planted(words, zlib.crc32(str(doc).encode()))
