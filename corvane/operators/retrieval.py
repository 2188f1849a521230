"""Scoring a catalogue of candidates for every task, fusing signals, ranking metrics.

The catalogue is cut by name into blocks of `BLOCK` candidates, and Spark builds one index per block: postings of
terms and of character pairs, with document frequencies and the mean length of the whole catalogue.
Neither the catalogue nor its postings pass through the driver. A batch of tasks meets one block at a time in
a kernel whose matrices hold at most `CELLS` scores; what leaves it is small: a maximum, counts, the places
ahead of a gold candidate, or the block's best k. Blocks are merged by task id. Where the indexes together are
checked to be under `BROADCAST_BYTES` they go to every task and the tasks stay where they are; beyond that
groups of tasks and blocks are dealt to meet in tasks of their own.

What depends on the whole catalogue, a task's greatest Okapi score and its gold candidates, is found in a
first round over the blocks (`profiles`) and joined to the tasks for the second; a catalogue of one block needs
one round and no shuffle.
"""

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.once import once
from ..functions.rules import grid_column, ratio
from ..functions.text import packed_ngrams, tokens
from ..session import stored

CELLS = 1 << 21  # scores of one kind held at once
BLOCK = 4096  # candidates in a block
PIECE = 512  # tasks scored at once, at most: their words and pairs are held several times over
GROUP = 1024  # tasks that meet a block together when both are dealt
BROADCAST_BYTES = 64 << 20  # largest index sent whole to every task
K1, B = 1.2, 0.75


def numbered(catalogue: DataFrame, name: str) -> DataFrame:
    """The catalogue (name, text) with `pos`, the place by name. Sorted by ranges; only row counts of the
    ranges are summed in one place."""
    sorted_ = stored(catalogue.select(name, "text").orderBy(name).withColumn("_m", F.monotonically_increasing_id()), "catalogue")
    part = F.shiftright("_m", 33)
    sizes = sorted_.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_s"))
    pos = (F.col("_s") + F.col("_m") - F.shiftleft(part, 33)).cast("int")
    return sorted_.join(F.broadcast(starts), part == F.col("_p")).select(name, "text", pos.alias("pos"))


@dataclass(frozen=True)
class Postings:
    """For each entry of a vocabulary, in order: the block's candidates holding it and its value there."""

    start: np.ndarray   # entry -> first place in pos
    pos: np.ndarray
    vals: np.ndarray    # one column per value
    n_cand: int

    def scores(self, rows: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_rows: int, column: int) -> np.ndarray:
        """Sums of weight * value over (row, entry) pairs, rows in order: a matrix (row, candidate)."""
        out = np.zeros((n_rows, self.n_cand))
        step = 256
        for lo in range(0, n_rows, step):
            a, b = np.searchsorted(rows, [lo, lo + step])
            used, at = np.unique(entries[a:b], return_inverse=True)
            wide = max(1, CELLS // max(1, self.n_cand))
            for u in range(0, len(used), wide):
                part = used[u:u + wide]
                mine = (at >= u) & (at < u + wide)
                x = np.zeros((min(step, n_rows - lo), len(part)))
                np.add.at(x, (rows[a:b][mine] - lo, at[mine] - u), weights[a:b][mine])
                counts = self.start[part + 1] - self.start[part]
                flat = np.repeat(self.start[part] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                m = np.zeros((len(part), self.n_cand))
                m[np.repeat(np.arange(len(part)), counts), self.pos[flat]] = self.vals[flat, column]
                out[lo:lo + step] += x @ m
        return out


def _postings(entry: np.ndarray, pos: np.ndarray, vals: np.ndarray, size: int, n_cand: int) -> Postings:
    order = np.lexsort((pos, entry))
    return Postings(np.searchsorted(entry[order], np.arange(size + 1)), pos[order], vals[order], n_cand)


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of a column of arrays."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _counted(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count) of the distinct terms of each row, by row, and the terms by code."""
    rows, flat = _ragged(column)
    coded = flat.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, count = np.unique(rows * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // width, pairs % width, count.astype(float), coded.dictionary


@dataclass(frozen=True)
class BlockIndex:
    first: int            # pos of the block's first candidate
    n: int
    terms: pa.Array
    lexical: Postings     # Okapi weight and count of each term
    squares: np.ndarray   # sum of squared term counts of each candidate
    pairs: np.ndarray     # character pairs, packed
    overlap: Postings
    sizes: np.ndarray     # distinct pairs of each candidate
    keys: list

    @cached_property
    def finder(self):
        """An automaton that finds the keys in a text, each with the candidates that have it, and the candidates of the empty key."""
        import ahocorasick

        at: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            at.setdefault(k, []).append(i)
        always = at.pop("", [])
        find = ahocorasick.Automaton()
        for k, where in at.items():
            find.add_word(k, where)
        if at:
            find.make_automaton()
        return find if at else None, always

    @staticmethod
    def build(cand: pa.Table, vocab: pa.Table, n_all: int, mean: float) -> "BlockIndex":
        cand = cand.sort_by("pos").combine_chunks()
        n = cand.num_rows
        row, code, tf, found = _counted(cand["terms"].combine_chunks())
        vocab = vocab.sort_by("term")
        terms = vocab["term"].combine_chunks()
        entry = pc.index_in(found, value_set=terms).to_numpy(zero_copy_only=False)[code] if len(code) else code
        df = vocab["df"].to_numpy()
        idf = np.log((n_all - df + 0.5) / (df + 0.5) + 1)
        length = np.bincount(row, tf, n)
        weight = idf[entry] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean)) if len(row) else tf
        gram_row, flat = _ragged(cand["grams"].combine_chunks())
        pairs, at = np.unique(flat.to_numpy(zero_copy_only=False), return_inverse=True)
        return BlockIndex(cand["pos"][0].as_py(), n, terms, _postings(entry, row, np.stack([weight, tf], 1), len(terms), n),
                          np.bincount(row, tf ** 2, n), pairs, _postings(at, gram_row, np.ones((len(at), 1)), len(pairs), n),
                          np.bincount(gram_row, minlength=n), cand["key"].to_pylist())


@dataclass(frozen=True)
class Index:
    blocks: DataFrame     # (block, body): one row per block
    n_blocks: int
    widest: int           # candidates in a block, at most
    size: int             # bytes of all bodies
    key: Callable


def index_catalogue(catalogue: DataFrame, key, block_rows: int = None) -> Index:
    """The index of a numbered catalogue, block by block, in the shared folder. `key` turns text into the form
    compared for containment."""
    block_rows = block_rows or BLOCK
    cand = stored(catalogue.select("pos", F.floor(F.col("pos") / block_rows).alias("block"), tokens(F.col("text")).alias("terms"),
                                   packed_ngrams(F.lower("text"), 2).alias("grams"), key(F.col("text")).alias("key")), "candidates")
    facts = cand.agg(F.count("*").alias("n"), F.avg(F.when(F.size("terms") > 0, F.size("terms"))).alias("mean")).first()
    n, mean = facts["n"], facts["mean"] or 1.0
    held = cand.select("block", F.explode(F.array_distinct("terms")).alias("term")).groupBy("block", "term").agg(F.count("*").alias("here"))
    everywhere = held.groupBy("term").agg(F.sum("here").alias("df"))
    vocab = held.join(everywhere, "term").select(F.col("block").alias("_b"), "term", "df")

    def build(cands, words):
        body = pickle.dumps(BlockIndex.build(cands, words, n, mean))
        return pa.table({"block": pa.array([cands["block"][0].as_py()], pa.int64()), "body": pa.array([body], pa.binary())})

    if not n:
        nothing = Postings(np.zeros(1, int), np.zeros(0, int), np.zeros((0, 2)), 0)
        empty = BlockIndex(0, 0, pa.array([], pa.string()), nothing, np.zeros(0), np.zeros(0, int), nothing, np.zeros(0, int), [])
        blocks = catalogue.sparkSession.createDataFrame([(0, bytearray(pickle.dumps(empty)))], "block long, body binary")
        return Index(blocks, 1, 1, 0, key)
    blocks = stored(cand.groupBy("block").cogroup(vocab.groupBy("_b")).applyInArrow(build, "block long, body binary"), "index")
    total = blocks.agg(F.count("*"), F.sum(F.length("body"))).first()
    return Index(blocks, total[0], min(n, block_rows), total[1] or 0, key)


class Scores:
    """The signals of a piece of tasks against a block: matrices bm25, bigram and cos, and the gold pairs."""

    def __init__(self, index: BlockIndex, terms, grams, keys):
        self.first, self.n = index.first, index.n
        row, code, tf, found = _counted(terms)
        squares = np.bincount(row, tf ** 2, len(terms))
        entry = pc.fill_null(pc.index_in(found, value_set=index.terms), -1).to_numpy(zero_copy_only=False)[code] if len(code) else code
        known = entry >= 0
        row, entry, tf = row[known], entry[known], tf[known]
        self.bm25 = index.lexical.scores(row, entry, np.ones(len(row)), len(terms), 0)
        dots = index.lexical.scores(row, entry, tf, len(terms), 1)  # whole numbers, so exact
        size = np.sqrt(squares[:, None] * index.squares[None, :])
        self.cos = dots / np.where(size > 0, size, 1)
        row, flat = _ragged(grams)
        code, inter = flat.to_numpy(zero_copy_only=False), np.zeros((len(grams), index.n))
        if len(index.pairs):
            at = np.minimum(np.searchsorted(index.pairs, code), len(index.pairs) - 1)
            keep = index.pairs[at] == code
            inter = index.overlap.scores(row[keep], at[keep], np.ones(keep.sum()), len(grams), 0)
        union = np.bincount(row, minlength=len(grams))[:, None] + index.sizes[None, :] - inter
        self.bigram = inter / np.maximum(union, 1)
        gold = _holding(keys, index.finder)
        self.gold_row = np.repeat(np.arange(len(gold)), [len(g) for g in gold])
        self.gold_at = np.array([i for g in gold for i in g], np.int64)


def _holding(column, finder) -> list[list[int]]:
    """For each text the positions of the keys that it contains, all found in one pass over it."""
    find, always = finder
    hits = ({i for _, where in (find.iter(t) if find and t else ()) for i in where} for t in column.to_pylist())
    return [sorted(h.union(always)) for h in hits]


def _char_pairs(column) -> pa.ListArray:
    """packed_ngrams(s, 2) of lower-cased texts: matching every place of a text by a regular expression takes longer than all scores."""
    texts = column.to_pylist()
    sizes = np.array([len(t or "") for t in texts], np.int64)
    chars = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[1:] == row[:-1]
    pairs = (row[:-1] << 42 | chars[:-1] << 21 | chars[1:])[inside]
    short = np.array([i for i, t in enumerate(texts) if t is not None and len(t) < 2], np.int64)
    alone = short << 42 | np.array([ord(texts[i]) << 21 if texts[i] else 0 for i in short], np.int64)
    found = np.unique(np.concatenate([pairs, alone]))
    return _lists(found >> 42, len(texts), pa.array(found & (1 << 42) - 1))


def _lists(rows: np.ndarray, n_rows: int, values) -> pa.ListArray:
    """Values as arrays of their rows; rows in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n_rows + 1)), pa.int32()), values)


def _matrix(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def score_blocks(tasks: DataFrame, index: Index, fn, schema: str, broadcast_bytes: int = None) -> DataFrame:
    """fn(columns of a piece of tasks, Scores) -> rows of `schema`, for every piece and block. tasks: id, text and
    what else fn needs."""
    out = tasks.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)
    given = tasks.select("id", tokens(F.col("text")).alias("_terms"), F.lower("text").alias("_low"),
                         index.key(F.col("text")).alias("_key"), *[c for c in tasks.columns if c not in ("id", "text")])
    piece = max(1, min(PIECE, CELLS // max(1, index.widest)))

    def met(batch, block):
        for lo in range(0, batch.num_rows, piece):
            part = batch.slice(lo, piece)
            rows = fn(part, Scores(block, part["_terms"], _char_pairs(part["_low"]), part["_key"]))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v.cast(f.type)
                                              for v, f in zip(rows, arrow)], schema=arrow)

    if index.size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        shared = tasks.sparkSession.sparkContext.broadcast([r["body"] for r in index.blocks.collect()])

        def scan(batches):
            held = [pickle.loads(b) for b in shared.value]
            for b in batches:
                for block in held:
                    yield from met(b, block)

        return given.mapInArrow(scan, out)

    groups = max(1, -(-tasks.count() // GROUP))
    ids = F.sequence(F.lit(0), F.lit(groups - 1))
    left = given.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.n_blocks - 1).cast("long"))))
    right = index.blocks.select(F.col("block").alias("_b"), "body", F.explode(ids).alias("_g"))

    def meet(lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return arrow.empty_table()
        block = pickle.loads(rt["body"][0].as_py())
        return pa.Table.from_batches([r for b in lt.combine_chunks().to_batches() for r in met(b, block)], schema=arrow)

    return left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInArrow(meet, out)


GOLD = "array<struct<pos:int,bm25:double,bigram:double,cos:double>>"


def _gold_rows(s: Scores, n_rows: int) -> pa.ListArray:
    r, c = s.gold_row, s.gold_at
    values = pa.StructArray.from_arrays([pa.array((c + s.first).astype(np.int32)), *(pa.array(m[r, c]) for m in (s.bm25, s.bigram, s.cos))],
                                        names=["pos", "bm25", "bigram", "cos"])
    return _lists(r, n_rows, values)


def _kept(tasks: DataFrame) -> tuple[list[str], str]:
    """The columns of the tasks that stay, and their schema."""
    kept = [c for c in tasks.columns if c not in ("text", "top", "known")]
    return kept, ", ".join(f"`{c}` {tasks.schema[c].dataType.simpleString()}" for c in kept)


def merged(parts: DataFrame, index: Index, kept: list[str], **aggs: Column) -> DataFrame:
    """Partial rows of the blocks as one row per task."""
    return parts if index.n_blocks == 1 else parts.groupBy(*kept).agg(*[a.alias(n) for n, a in aggs.items()])


def profiles(tasks: DataFrame, index: Index, **sizes) -> DataFrame:
    """Per task: `top` (greatest Okapi score, 0 without shared terms), `best` and `total` of the character-pair overlap,
    and `known`, the gold candidates with their raw signals."""
    kept, schema = _kept(tasks)

    def fn(part, s):
        return [*(part[c] for c in kept), s.bm25.max(1, initial=0.0), s.bigram.max(1, initial=0.0), s.bigram.sum(1),
                _gold_rows(s, part.num_rows)]

    parts = score_blocks(tasks, index, fn, f"{schema}, top double, best double, total double, known {GOLD}", **sizes)
    return merged(parts, index, kept, top=F.max("top"), best=F.max("best"), total=F.sum("total"), known=F.flatten(F.collect_list("known")))


def with_profiles(tasks: DataFrame, index: Index, **sizes) -> DataFrame:
    """tasks with what the second round needs to know of the whole catalogue; nothing for a single block."""
    if index.n_blocks == 1:
        return tasks
    return tasks.join(profiles(tasks.select("id", "text"), index, **sizes).select("id", "top", "known"), "id")


class Known:
    """A piece's normalised signals (0 to 1 for bm25) and its gold candidates over all blocks."""

    def __init__(self, part, s: Scores):
        if "top" in part.schema.names:
            top = part["top"].to_numpy(zero_copy_only=False)
            self.row, flat = _ragged(part["known"])
            self.pos, bm, bi, cos = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False) for i in range(4))
        else:
            top = s.bm25.max(1, initial=0.0)
            self.row, self.pos = s.gold_row, s.gold_at + s.first
            bm, bi, cos = (m[s.gold_row, s.gold_at] for m in (s.bm25, s.bigram, s.cos))
        scale = np.where(top > 0, top, 1)
        self.gold = bm / scale[self.row], bi, cos
        self.all = s.bm25 / scale[:, None], s.bigram, s.cos
        self.cand = s.first + np.arange(s.n)

    @cached_property
    def near(self) -> tuple[np.ndarray, tuple]:
        """For each gold pair its place in the signals of the tasks with gold candidates, the only ones where places are looked for."""
        rows, at = np.unique(self.row, return_inverse=True)
        return at, tuple(m[rows] for m in self.all)

    def ahead(self, score) -> np.ndarray:
        """For each gold pair, the block's candidates that stand before it: higher scores, equal ones by place."""
        at, near = self.near
        own, every = score(*self.gold), score(*near)
        out = np.zeros(len(own), np.int64)
        for lo in range(0, len(own), 256):
            o, p, m = own[lo:lo + 256, None], self.pos[lo:lo + 256, None], every[at[lo:lo + 256]]
            out[lo:lo + 256] = ((m > o) | ((m == o) & (self.cand[None, :] < p))).sum(1)
        return out


def gold_places(tasks: DataFrame, index: Index, scores: dict, **sizes) -> DataFrame:
    """The 1-based place of the first gold candidate under each score, a column each; null without gold. A score
    is a function of arrays (bm25 over the task's greatest, bigram, cos); ties keep catalogue order."""
    kept, schema = _kept(tasks)

    def fn(part, s):
        k, columns = Known(part, s), []
        for score in scores.values():
            own = score(*k.gold)
            order = np.lexsort((k.pos, -own, k.row))
            first = order[np.unique(k.row[order], return_index=True)[1]]
            place = np.full(part.num_rows, -1)
            best = Known.__new__(Known)
            best.row, best.pos, best.gold, best.all, best.cand = k.row[first], k.pos[first], tuple(g[first] for g in k.gold), k.all, k.cand
            place[best.row] = best.ahead(score)
            columns.append(pa.array(place, pa.int64(), mask=place < 0))
        return [*(part[c] for c in kept), *columns]

    parts = score_blocks(with_profiles(tasks, index, **sizes), index, fn, ", ".join([schema, *(f"`{n}` long" for n in scores)]), **sizes)
    whole = merged(parts, index, kept, **{n: F.sum(n) for n in scores})
    return whole.select(*kept, *[(F.col(n) + 1).alias(n) for n in scores])


BEST = "array<struct<s:double,pos:int,bm25:double,bigram:double,cos:double,gold:boolean>>"


def best_candidates(tasks: DataFrame, index: Index, lists: dict, scope=None, **sizes) -> DataFrame:
    """For each name of `lists`, (score, k, threshold or None): the best k candidates, an array of (s, pos, bm25, bigram,
    cos, gold) with s = -score, rising by (s, pos). Also n_gold, and of the candidates for which
    scope(bm25, bigram, cos) holds n_scope and scope_gold, whether one of them is gold."""
    kept, schema = _kept(tasks)

    def fn(part, s):
        k, n = Known(part, s), part.num_rows
        gold = np.zeros(s.bm25.shape, bool)
        gold[s.gold_row, s.gold_at] = True
        inside = scope(*k.all) if scope else np.zeros(gold.shape, bool)
        columns = [pa.array(gold.sum(1)), pa.array(inside.sum(1)), pa.array((inside & gold).any(1))]
        for score, top, least in lists.values():
            every = score(*k.all)
            order = np.argsort(-every, 1, kind="stable")[:, :top]
            row, col = np.repeat(np.arange(n), order.shape[1]), order.ravel()
            if least is not None:
                keep = every[row, col] >= least
                row, col = row[keep], col[keep]
            fields = [pa.array(-every[row, col]), pa.array((col + s.first).astype(np.int32)), *(pa.array(m[row, col]) for m in k.all),
                      pa.array(gold[row, col])]
            columns.append(_lists(row, n, pa.StructArray.from_arrays(fields, names=["s", "pos", "bm25", "bigram", "cos", "gold"])))
        return [*(part[c] for c in kept), *columns]

    given = with_profiles(tasks, index, **sizes)
    parts = score_blocks(given, index, fn, ", ".join([schema, "n_gold long, n_scope long, scope_gold boolean",
                                                      *(f"`{n}` {BEST}" for n in lists)]), **sizes)
    best = {n: F.slice(F.array_sort(F.flatten(F.collect_list(n))), 1, top) for n, (_, top, _) in lists.items()}
    return merged(parts, index, kept, n_gold=F.sum("n_gold"), n_scope=F.sum("n_scope"), scope_gold=F.max("scope_gold"), **best)


def pair_scores(tasks: DataFrame, index: Index, **sizes) -> DataFrame:
    """(id, pos, bm25, cos) of every task and candidate that share a term; bm25 is the raw Okapi sum."""
    def fn(part, s):
        row, col = np.nonzero(s.bm25 > 0)
        return [part["id"].take(pa.array(row)), (col + s.first).astype(np.int32), s.bm25[row, col], s.cos[row, col]]

    return score_blocks(tasks.select("id", "text"), index, fn, "id long, pos int, bm25 double, cos double", **sizes)


def signals(tasks: DataFrame, catalogue: DataFrame, key, block_rows: int = None, **sizes) -> DataFrame:
    """One row per task with whole arrays over a catalogue small enough for a row: bm25 (over the row's greatest),
    bigram (Jaccard of character pairs) and cos, and the positions of the gold candidates."""
    index = index_catalogue(catalogue, key, block_rows)
    kept, schema = _kept(tasks)
    names = ["bm25", "bigram", "cos"]

    def fn(part, s):
        k = Known(part, s)
        gold = _lists(s.gold_row, part.num_rows, pa.array((s.gold_at + s.first).astype(np.int32)))
        bm, bi, cos = map(_matrix, k.all)
        return [*(part[c] for c in kept), np.full(part.num_rows, s.first, np.int32), bm, bi, gold, cos]

    arrays = "first int, bm25 array<double>, bigram array<double>, gold array<int>, cos array<double>"
    parts = score_blocks(with_profiles(tasks, index, **sizes), index, fn, f"{schema}, {arrays}", **sizes)
    if index.n_blocks > 1:
        parts = parts.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("first", *names, "gold"))).alias("_p")).select(
            *kept, *[F.flatten(F.col("_p")[n]).alias(n) for n in (*names, "gold")])
    return parts.select(*kept, "bm25", "bigram", "gold", "cos")


# --- on the best candidates of a row -----------------------------------------------------------

def fused_score(wl: float, wb: float, base: float):
    """max(wl * bm25, wb * bigram, max(0, cos - base)) as a score of gold_places and best_candidates."""
    return lambda bm, bi, cos: np.maximum(np.maximum(wl * bm, wb * bi), np.maximum(0.0, cos - base))


def first_gold(entries: Column) -> Column:
    """1-based place of the first gold entry of a list of candidates, null if there is none."""
    place = F.array_position(F.transform(entries, lambda x: x["gold"]), F.lit(True))
    return F.when(place > 0, place)


def prf_of_lists(df: DataFrame, selected: str, by=()) -> DataFrame:
    """micro_prf for a selection made by best_candidates."""
    tp, size = F.size(F.filter(selected, lambda x: x["gold"])), F.size(selected)
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(tp).alias("tp"), F.sum(size - tp).alias("fp"),
                                 F.sum(F.col("n_gold") - tp).alias("fn"),
                                 F.avg(F.coalesce(F.get(selected, F.lit(0))["gold"], F.lit(False)).cast("double")).alias("hit1"),
                                 F.avg((size == 0).cast("double")).alias("empty"))
    return counts.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def rerank_candidates(df: DataFrame, first: str, w: float) -> DataFrame:
    """`order`: a first stage's best candidates by (1 - w) * bm25 + w * cos, ties by place."""
    def mixed(x):
        return F.struct((-((1 - w) * x["bm25"] + w * x["cos"])).alias("s"), x["pos"].alias("pos"), x["gold"].alias("gold"))

    return once(df, order=F.array_sort(F.transform(first, mixed)))


def rerank_by_score_table(df: DataFrame, first: str, scores: DataFrame) -> DataFrame:
    """`order`: a first stage's best candidates by an outside score table (id, pos, score); candidates the
    table lacks come last."""
    cand = df.select("id", F.explode(first).alias("x")).select("id", "x.pos", "x.gold")
    scored = cand.join(scores, ["id", "pos"], "left")
    entry = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "pos", "gold")
    return df.join(scored.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("order")), "id", "left")


def union_candidates(df: DataFrame, grid: list[dict], head: str, first: str, in_scope) -> DataFrame:
    """Recall and size of scope + the head's best k from theta up + the first stage's best n, per grid point.
    The lists and the scope's counts come from best_candidates; in_scope(entry) tells its members in the lists."""
    rows = df.withColumn("g", F.explode(grid_column(grid)))

    def outside(entries):
        return F.transform(F.filter(entries, lambda x: ~in_scope(x)), lambda x: F.struct(x["pos"].alias("pos"), x["gold"].alias("gold")))

    confident = F.filter(F.slice(head, F.lit(1), F.col("g.k")), lambda x: -x["s"] >= F.col("g.theta"))
    rows = once(rows, _u=F.array_union(outside(confident), outside(F.slice(first, F.lit(1), F.col("g.n")))))
    found = F.col("scope_gold") | F.exists("_u", lambda x: x["gold"])
    return rows.groupBy(F.col("g.k").alias("k"), F.col("g.theta").alias("theta"), F.col("g.n").alias("first_n")).agg(
        F.count("*").alias("n"), F.avg(found.cast("double")).alias("recall"),
        F.avg(F.col("n_scope") + F.size("_u")).alias("mean_size"), F.avg(F.col("scope_gold").cast("double")).alias("scope_only"))


TALLY = ["wl double", "wb double", "base double", "n long", "tp long", "fp long", "fn long", "hit long", "none long"]


def _tally(points, n: int, chosen, own, ahead, thr, k) -> list:
    """Counts of a set of tasks at each grid point. chosen (task, point): candidates from thr up; own and ahead (gold pair,
    point): its score and the candidates before it."""
    capped = np.minimum(chosen, k)
    tp = ((own >= thr) & (ahead < k)).sum(0)
    return [*points.T, np.full(len(points), n), tp, capped.sum(0) - tp, len(own) - tp, ((own >= thr) & (ahead == 0)).sum(0), (capped == 0).sum(0)]


class Reached:
    """Counts of candidates whose fused_score reaches a threshold, at many points (wl, wb, base) at once.

    A score is the greatest of three, so it reaches the threshold where one of them does: the two weighted signals are compared once
    per weight, and a cosine passes the first bases in rising order up to one that is looked up. What no weighted signal
    decides is counted by that place, per pair of weights; no score is made per point.
    """

    def __init__(self, points: np.ndarray, thr: float):
        self.thr = thr
        self.wl, self.wb, self.bases = (np.unique(c) for c in points.T)
        self.i, self.j, self.at = (np.searchsorted(u, c) for u, c in zip((self.wl, self.wb, self.bases), points.T))

    def _passes(self, cos: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each cosine reaches the threshold over the base at its place; no base after the last one."""
        base = np.append(self.bases, np.inf)[np.minimum(place, len(self.bases))]
        return (place < len(self.bases)) & (np.maximum(0.0, cos - base) >= self.thr)

    def passed(self, cos: np.ndarray) -> np.ndarray:
        """The number of bases over which each cosine reaches the threshold. The place is looked up and moved to where the rounded
        difference itself passes, so equal numbers come out as in fused_score."""
        if self.thr <= 0:
            return np.full(len(cos), len(self.bases))
        n = np.searchsorted(self.bases, cos - self.thr, side="right")
        while (more := self._passes(cos, n)).any():
            n += more
        while (less := (n > 0) & ~self._passes(cos, n - 1)).any():
            n -= less
        return n

    def __call__(self, bm: np.ndarray, bi: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """(row, point): the candidates of each row that reach the threshold."""
        out, width = np.empty((len(bm), len(self.at)), np.int64), len(self.bases) + 1
        row, col = np.nonzero(np.maximum(0.0, cos - self.bases[0]) >= self.thr)
        cell = row * width + self.passed(cos[row, col])
        lexical, pairs = [w * bm >= self.thr for w in self.wl], [w * bi >= self.thr for w in self.wb]
        for i, j in np.unique(np.stack([self.i, self.j], 1), axis=0):
            decided = lexical[i] | pairs[j]
            by_place = np.bincount(cell[~decided[row, col]], minlength=len(bm) * width).reshape(len(bm), width)
            # over the base at place b: those that pass more than b bases
            over = by_place[:, ::-1].cumsum(1)[:, ::-1][:, 1:] + decided.sum(1)[:, None]
            here = (self.i == i) & (self.j == j)
            out[:, here] = over[:, self.at[here]]
        return out


def fusion_sweep(tasks: DataFrame, index: Index, grid: list[dict], thr=0.15, k=5, **sizes) -> DataFrame:
    """Pooled counts and F1 of the selection by fused_score at each (wl, wb, base).

    Nothing is sorted: only the number of candidates over the threshold and those before each gold one are needed. A catalogue of
    one block gives a row of counts per batch and point; else a task's counts are summed over the blocks first.
    """
    points = np.array([[p["wl"], p["wb"], p["base"]] for p in grid])
    scores, reached = [fused_score(*p) for p in points], Reached(points, thr)

    def counted(part, s):
        kn = Known(part, s)
        return kn, reached(*kn.all), np.stack([kn.ahead(f) for f in scores], 1)

    def own(gold):
        return np.stack([f(*gold) for f in scores], 1)

    def whole(part, s):
        kn, chosen, ahead = counted(part, s)
        return _tally(points, part.num_rows, chosen, own(kn.gold), ahead, thr, k)

    def partial(part, s):
        kn, chosen, ahead = counted(part, s)
        flat = pa.ListArray.from_arrays(pa.array(len(points) * np.searchsorted(kn.row, np.arange(part.num_rows + 1)), pa.int32()),
                                        pa.array(ahead.ravel()))
        return [part["id"], _matrix(chosen), flat, *(_lists(kn.row, part.num_rows, pa.array(g)) for g in kn.gold)]

    def added(table):
        table = table.sort_by("id").combine_chunks()
        ids, task = np.unique(table["id"].to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), len(points)), np.int64)
        np.add.at(total, task, np.stack(table["chosen"].to_numpy(zero_copy_only=False)))
        first = np.unique(task, return_index=True)[1]
        golds = [table[c].to_pylist() for c in ("g0", "g1", "g2")]
        gold = [np.array([v for i in first for v in g[i]], float) for g in golds]
        start = np.concatenate([[0], np.cumsum([len(golds[0][i]) for i in first])])
        ahead = np.zeros((start[-1], len(points)), np.int64)
        for i, flat in zip(task, table["ahead"].to_pylist()):
            ahead[start[i]:start[i + 1]] += np.array(flat, np.int64).reshape(-1, len(points))
        return pa.table(_tally(points, len(ids), total, own(gold), ahead, thr, k), names=[t.split()[0] for t in TALLY])

    given = with_profiles(tasks.select("id", "text"), index, **sizes)
    if index.n_blocks == 1:
        counts = score_blocks(given, index, whole, ", ".join(TALLY), **sizes)
    else:
        parts = score_blocks(given, index, partial, "id long, chosen array<long>, ahead array<long>, g0 array<double>, g1 array<double>, g2 array<double>", **sizes)
        groups = max(1, -(-tasks.count() // 256))
        counts = parts.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups))).applyInArrow(added, ", ".join(TALLY))
    return _sweep_totals(counts)


# --- inside a row ------------------------------------------------------------------------------

def fuse_max_select(df: DataFrame, base, wl=1.0, wb=1.0, thr=0.15, k=5, out="selected") -> DataFrame:
    """The top k positions by max(wl * bm25, wb * bigram, max(0, cos - base)) from thr up."""

    def c(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    zipped = F.arrays_zip(F.col("bm25").alias("b"), F.col("bigram").alias("g"), F.col("cos").alias("c"))
    scored = F.transform(zipped, lambda z, i: F.struct(
        (-F.greatest(c(wl) * z["b"], c(wb) * z["g"], F.greatest(F.lit(0.0), z["c"] - c(base)))).alias("s"), i.alias("i")))
    kept = F.array_sort(F.filter(scored, lambda x: -x["s"] >= thr))
    return once(df, **{out: F.transform(F.slice(kept, 1, k), lambda x: x["i"])})


def micro_prf(df: DataFrame, selected: str = "selected", gold: str = "gold", by=()) -> DataFrame:
    """Precision, recall and F1 over pooled counts, first-choice hits, share selecting nothing."""
    tp = F.sum(F.size(F.array_intersect(selected, gold)))
    fp = F.sum(F.size(F.array_except(selected, gold)))
    fn = F.sum(F.size(F.array_except(gold, selected)))
    hit = F.when(F.size(selected) > 0, F.array_contains(F.col(gold), F.get(F.col(selected), 0))).otherwise(False)
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                                 F.avg(hit.cast("double")).alias("hit1"), F.avg((F.size(selected) == 0).cast("double")).alias("empty"))
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def rank_metrics(df: DataFrame, place: str, by=(), ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Any-hit recall at k and mean reciprocal place of the first hit; rows without one count 0."""
    p = F.col(place)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(F.coalesce((p <= k).cast("double"), F.lit(0.0))).alias(f"r{k}") for k in ks],
        F.avg(F.coalesce(1 / p, F.lit(0.0))).alias("mrr"))



def ndcg_mrr_at(df: DataFrame, rank: str, k: int = 10, by=()) -> DataFrame:
    """For one gold per query: mean of 1/log2(rank + 1) and of 1/rank, 0 beyond k."""
    r = F.col(rank)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg"),
        F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias("mrr"))


def baseline_sweep(df: DataFrame, grid: list[dict], thr=0.15, k=5) -> DataFrame:
    """Pooled counts and F1 of fuse_max_select at each (wl, wb, base).

    Nothing is sorted: of each batch only the number of candidates over the threshold and the
    places of the gold ones are needed, and a task sends one row of counts per batch and point.
    """
    points = np.array([[p["wl"], p["wb"], p["base"]] for p in grid])

    def count(batches):
        for pdf in (whole.iloc[i:i + 512] for whole in batches for i in range(0, len(whole), 512)):
            bm, bi, cos = (np.stack(pdf[c].to_numpy()) for c in ("bm25", "bigram", "cos"))
            row, g = _ragged(pa.array(pdf["gold"], pa.list_(pa.int64())))
            g = g.to_numpy(zero_copy_only=False)
            cand = np.arange(bm.shape[1])
            out = np.zeros((len(points), 5))
            for i, (wl, wb, base) in enumerate(points):
                sc = np.maximum(np.maximum(wl * bm, wb * bi), np.maximum(0.0, cos - base))
                chosen = np.minimum((sc >= thr).sum(1), k)
                own = sc[row, g]
                ahead = (sc[row] > own[:, None]) | ((sc[row] == own[:, None]) & (cand[None, :] < g[:, None]))
                place = ahead.sum(1)
                tp = ((own >= thr) & (place < k)).sum()
                out[i] = tp, chosen.sum() - tp, len(g) - tp, ((own >= thr) & (place == 0)).sum(), (chosen == 0).sum()
            yield pd.DataFrame({"wl": points[:, 0], "wb": points[:, 1], "base": points[:, 2], "n": len(pdf),
                                **{c: out[:, j].astype(int) for j, c in enumerate(("tp", "fp", "fn", "hit", "none"))}})

    counts = df.select("bm25", "bigram", "cos", "gold").mapInPandas(
        count, "wl double, wb double, base double, n bigint, tp bigint, fp bigint, fn bigint, hit bigint, none bigint")
    return _sweep_totals(counts)


def _sweep_totals(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("wl", "wb", "base").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "hit", "none")])
    return total.withColumn("hit1", F.col("hit") / F.col("n")).withColumn("empty", F.col("none") / F.col("n")).withColumn(
        "f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).drop("hit", "none")
