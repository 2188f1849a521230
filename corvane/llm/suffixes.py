"""Operator 2, passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept at minimisers, word k-grams that are the least of their window by hash: each depends on
the words around it alone, so two copies of a passage of window + k - 1 words keep suffixes at the same
words. Spark sorts the kept suffixes, and those of the reversed text, which end with the same k-gram; a
suffix's nearest neighbours of another text tell how far any other text agrees with it to the right, and
to the left. Where both together make `least` words the stretch is looked at: neighbours of the two
sides may be different texts, so its windows are hashed and counted by least and greatest text.

The sort key holds the text too, so a suffix on a third of all documents is split over tasks like any
other; the few rows at the edges of tasks are compared once more, together. Equal texts are one text, whose
copies repeat as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Combiner, columns, pieces, stored
from .ngram_join import HASHES, MIX

TEXTS = "key long, tag long, n_words long, ids array<long>, body binary"
GRAM, WINDOW = 8, 36  # words of a k-gram, k-grams of a window
SUFFIX = "tag long, ctx long, suffix binary"
MATCH = "tag long, ctx long, side int, length int, edge binary"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams of words with hashes `h`."""
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        g = (g ^ h[i:i + n]) * np.uint64(MIX[i % 5])
        g ^= g >> np.uint64(29)
    return g


def minimisers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the least of a window. Of equal hashes that follow each
    other one per window is kept, so a text of one word repeated has few."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = grams(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)))
    w = min(WINDOW, n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, w).argmin(1) + np.arange(n - w + 1))
    if (g[at][1:] == g[at][:-1]).any():
        kept, last = [], -WINDOW
        for i, p in enumerate(at.tolist()):
            if not kept or g[p] != g[kept[-1]] or p - last >= WINDOW:
                kept.append(p)
                last = p
        at = np.array(kept)
    return at, g[at].view(np.int64)


def _texts(max_bytes):
    def run(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        pack, groups = zstandard.ZstdCompressor(level=3).compress, Combiner(max_bytes=max_bytes)

        def flush():
            nonlocal made
            rows = list(groups.take())
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                keys = list(range(base + made, base + made + len(part)))
                made += len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array([int.from_bytes(hashlib.sha256(b).digest()[:8], "little", signed=True) for _, b, _ in part], pa.int64()),
                    pa.array([len(b.split()) for _, b, _ in part], pa.int64()), pa.array([ids for _, _, ids in part], pa.list_(pa.int64())),
                    pa.array([pack(b) for _, b, _ in part], pa.binary())], names=["key", "tag", "n_words", "ids", "body"])

        for b in pieces(batches, 4 << 20):
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if groups.add(row_id, b" ".join(words_of(text))):
                    yield from flush()
        yield from flush()

    return run


def _anchors(batches):
    for b in pieces(batches, 1 << 20):
        h, tag = [], []
        for t, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            _, g = minimisers(zstandard.decompress(body).split())
            g = np.unique(g)
            h.append(g)
            tag.append(np.full(len(g), t))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h), pa.int64()), pa.array(np.concatenate(tag), pa.int64())], names=["h", "tag"])


def windows(h: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all stretches of `least` words, from those of stretches of 1, 2, 4, ... words."""
    n = len(h) - least + 1
    out, part, size, at = np.zeros(n, np.uint64), h, 1, 0
    while True:
        if least & size:
            out = (out ^ part[at:at + n]) * np.uint64(MIX[0])
            out ^= out >> np.uint64(31)
            at += size
        if at == least:
            return out.view(np.int64)
        part = (part[:-size] * np.uint64(MIX[1])) ^ (part[:-size] >> np.uint64(33)) ^ (part[size:] * np.uint64(MIX[3]))
        part ^= part >> np.uint64(29)
        size *= 2


def places(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of all minimisers of words with hashes `h`. The context is what a passage
    of `least` words around the k-gram may hold; equal contexts of one text match alike, so one stands for all."""
    g = grams(h)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, WINDOW).argmin(1) + np.arange(len(g) - WINDOW + 1))
    padded = np.concatenate([np.zeros(least - GRAM, np.uint64), h, np.zeros(least, np.uint64)])
    return at, g[at].view(np.int64), windows(padded, 2 * least - GRAM)[at]


def _suffixes(least: int):
    """Kept suffixes whose k-gram is among the wanted ones, to the right and reversed to the left, as 16 bits a word
    behind a word for the side. Words are told apart again by the windows' hashes, so no more bits are needed."""

    def run(batches):
        for b in pieces(batches, 1 << 19):
            cols = [[], [], []]
            for tag, wanted, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = np.fromiter(map(HASHES.__getitem__, words := zstandard.decompress(body).split()), np.uint64, len(words))
                at, g, ctx = places(h, least)
                use = np.isin(g, np.array(wanted, np.int64))
                _, first = np.unique(ctx[use], return_index=True)
                word = (h >> np.uint64(48)).astype(">u2")
                right, left = word.tobytes(), word[::-1].tobytes()
                for p, c in zip(at[use][first].tolist(), ctx[use][first].tolist()):
                    q = len(h) - p - GRAM
                    cols[0] += [tag, tag]
                    cols[1] += [c, c]
                    cols[2] += [b"\0\0" + right[2 * p:2 * (p + least)], b"\0\1" + left[2 * q:2 * (q + least)]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                             names=["tag", "ctx", "suffix"])

    return run


def nearest(suffix: list[bytes], tag: np.ndarray, width: int) -> np.ndarray:
    """Longest common prefix, in words, of each of the sorted suffixes with one of another text."""
    n = len(suffix)
    size = np.fromiter(map(len, suffix), np.int64, n) // 2
    grid = np.frombuffer(b"".join(s.ljust(2 * width, b"\0") for s in suffix), ">u2").reshape(n, width)
    same = np.column_stack([grid[1:] == grid[:-1], np.zeros(n - 1, bool)])
    lcp = np.minimum(same.argmin(1), np.minimum(size[1:], size[:-1]))  # of i and i + 1
    best = np.zeros(n, np.int64)
    cut = np.flatnonzero(tag[1:] != tag[:-1]) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), n]):  # a run of one text
        if i:
            best[i:j] = np.minimum.accumulate(lcp[i - 1:j - 1])
        if j < n:
            best[i:j] = np.maximum(best[i:j], np.minimum.accumulate(lcp[i:j][::-1])[::-1])
    return best


def _neighbours(least: int, edges: bool):
    """(tag, ctx, side, words in common, suffix where it is at an edge) of sorted suffixes. The last run of one text and
    the row before it wait for the next batch; the edges of a task are its first and last run and the row beside each."""

    def run(batches):
        rows, edge, told, opening = [[], [], []], [], 0, True

        def out(until):
            length = nearest(rows[2], np.array(rows[0]), least + 1)[told:until] - 1
            keep = (np.flatnonzero((length >= GRAM) | np.array(edge[told:until])) + told).tolist()
            return pa.RecordBatch.from_arrays([
                pa.array([rows[0][i] for i in keep], pa.int64()), pa.array([rows[1][i] for i in keep], pa.int64()),
                pa.array([rows[2][i][1] for i in keep], pa.int32()), pa.array([int(length[i - told]) for i in keep], pa.int32()),
                pa.array([rows[2][i] if edge[i] else None for i in keep], pa.binary())], names=["tag", "ctx", "side", "length", "edge"])

        for b in pieces(batches, 4 << 20):
            for c, v in zip(rows, b.columns):
                c += v.to_pylist()
            edge += [False] * b.num_rows
            tags = np.array(rows[0])
            other = np.flatnonzero(tags != tags[-1])
            if not len(other):
                continue
            if opening and edges:
                n = int(np.flatnonzero(tags != tags[0])[0]) + 1
                edge[:n] = [True] * n
            opening = False
            waits = int(other[-1])  # the row before the last run
            if waits > told:
                yield out(waits)
                other = np.flatnonzero(tags[:waits] != tags[waits])
                above = [int(other[-1])] if len(other) else []  # what the waiting row is compared with
                rows, edge, told = [[c[i] for i in above] + c[waits:] for c in rows], [edge[i] for i in above] + edge[waits:], len(above)
        if rows[0]:
            tags = np.array(rows[0])
            other = np.flatnonzero(tags != tags[-1])
            if edges:
                at = max(int(other[-1]), told) if len(other) else 0
                edge[at:] = [True] * (len(edge) - at)
            yield out(len(edge))

    return run


def _windows(least: int):
    """(h, tag, pos) of the stretches of `least` words that other texts may hold by what neighbours told."""

    def run(batches):
        for b in pieces(batches, 1 << 20):
            cols = [[], [], []]
            for tag, found, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = zstandard.decompress(body).split()
                h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
                reach = {}
                for f in found:
                    both = reach.setdefault(f["ctx"], [0, 0])
                    both[f["side"]] = max(both[f["side"]], f["length"])
                at, _, ctx = places(h, least)
                right, left = np.array([reach.get(c, (0, 0)) for c in ctx.tolist()], np.int64).reshape(-1, 2).T
                start, stop = at - (left - GRAM), at + right - least + 1
                use = (left >= GRAM) & (right >= GRAM) & (start < stop)
                mark = np.zeros(len(h) + 2, np.int64)
                np.add.at(mark, start[use], 1)
                np.add.at(mark, stop[use], -1)
                at = np.flatnonzero(np.cumsum(mark) > 0)
                for c, v in zip(cols, (windows(h, least)[at], np.full(len(at), tag), at)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))],
                                             names=["h", "tag", "pos"])

    return run


def _stretches(least: int):
    """Overlapping or touching stretches of `least` words as one."""

    def run(batches):
        for b in batches:
            cols = [[], [], []]
            for tag, at in zip(b.column(0).to_pylist(), b.column(1)):
                at = np.unique(at.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > least)
                start = at[np.r_[0, cut + 1]]
                for c, v in zip(cols, (np.full(len(start), tag), start, at[np.r_[cut, len(at) - 1]] + least)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["tag", "start", "stop"])

    return run


def _merged(spans):
    """Overlapping or touching spans as one, by start."""
    span = "struct<start:long,stop:long>"

    def step(acc, s):
        tail = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(tail["start"].alias("start"), F.greatest(tail["stop"], s["stop"]).alias("stop"))
        return F.when(tail["stop"] >= s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{span}>"), step)


def repeated_passages(df: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = 50, max_bytes: int = 32 << 20) -> DataFrame:
    """One row per repeated stretch of a row: id, start_word, stop_word (exclusive), n_words of the stretch.

    A stretch is a union of overlapping passages of `least` words (window + k - 1 at least, so that no
    passage slips through) that occur in another row too, each in any row and any number of times. Words
    are compared with A-Z lower-cased and any white space between them, passages by 64-bit hashes. Rows
    with equal words repeat as a whole if long enough. Null, empty and shorter texts give no rows; null
    ids are reported as such; an empty table gives none.
    """
    if least < WINDOW + GRAM - 1:
        raise ValueError(f"passages under {WINDOW + GRAM - 1} words may hold no anchor")
    texts = stored(columns(df, row_id, text).mapInArrow(_texts(max_bytes), TEXTS), "texts").filter(F.col("n_words") >= least)
    one = texts.groupBy("tag").agg(F.min("key").alias("key"), F.sum(F.size("ids")).alias("copies"), F.first("n_words").alias("n_words"))
    anchors = stored(texts.select("tag", "body").mapInArrow(_anchors, "h long, tag long"), "anchors")
    shared = anchors.groupBy("h").agg(F.min("tag").alias("t1"), F.max("tag").alias("t2")).filter("t1 != t2").select("h")
    wanted = anchors.join(shared, "h").groupBy("tag").agg(F.collect_set("h").alias("wanted")).join(one.select("tag", "key"), "tag")
    suffixes = stored(wanted.join(texts.select("key", "body"), "key").select("tag", "wanted", "body").mapInArrow(
        _suffixes(least), SUFFIX), "suffixes")
    order = ["suffix", "tag", "ctx"]
    told = stored(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select("tag", "ctx", "suffix").mapInArrow(
        _neighbours(least, True), MATCH), "neighbours")
    edges = told.filter("edge IS NOT NULL").select("tag", "ctx", F.col("edge").alias("suffix")).repartition(1).sortWithinPartitions(
        *order).mapInArrow(_neighbours(least, False), MATCH)  # a few rows a task
    found = told.unionByName(edges).filter(F.col("length") >= GRAM).groupBy("tag").agg(
        F.collect_list(F.struct("ctx", "side", "length")).alias("found")).join(one.select("tag", "key"), "tag")
    held = stored(found.join(texts.select("key", "body"), "key").select("tag", "found", "body").mapInArrow(
        _windows(least), "h long, tag long, pos int"), "windows")
    # written, so that the join below has shuffles of its own and Spark deals a hot window over tasks
    twice = stored(held.groupBy("h").agg(F.min("tag").alias("t1"), F.max("tag").alias("t2")).filter("t1 != t2").select("h"), "repeats")
    hits = held.join(twice, "h").groupBy("tag").agg(F.collect_list("pos").alias("at"))
    spans = hits.mapInArrow(_stretches(least), "tag long, start long, stop long").select("tag", F.struct("start", "stop").alias("s")).unionByName(
        one.filter("copies > 1").select("tag", F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")).alias("s")))
    merged = spans.groupBy("tag").agg(F.collect_set("s").alias("spans")).select("tag", F.explode(_merged(F.col("spans"))).alias("s"))
    rows = merged.join(texts.select("tag", "ids"), "tag")
    return rows.select(F.explode("ids").alias("id"), F.col("s.start").alias("start_word"), F.col("s.stop").alias("stop_word"),
                       (F.col("s.stop") - F.col("s.start")).alias("n_words"))
