"""Exact and near duplicates, leakage control, funnels."""

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.ranking import exact_percentiles
from ..functions.text import char_ngrams, squeezed
from ..session import scratch_path, stored
from ..sources.paths import make_folder, open_path
from .joins import union_refs


def exact_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order columns.

    `row_number = 1` is pushed before the shuffle by Spark's group limit, so each task sends
    at most one row per key even when one key holds a third of the rows.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_ids(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The least row id of every key: small partial aggregates, one row per key."""
    return df.groupBy(key).agg(F.min(row_id).alias(row_id))


def pair_dedup(df: DataFrame, left: str, right: str, order: str, held_out: DataFrame) -> DataFrame:
    """First row of each (left, right) key pair, without rows whose left or right key is held out."""
    ho = held_out.select(F.col("key")).distinct()
    kept = df.join(ho.withColumnRenamed("key", left), left, "left_anti").join(
        ho.withColumnRenamed("key", right), right, "left_anti"
    )
    return exact_dedup(kept, [left, right], [order])


def content_hash_dedup(df: DataFrame, text: str, row_id: str) -> DataFrame:
    return exact_dedup(df.withColumn("content_md5", F.md5(text)), ["content_md5"], [row_id])


def shuffled_cap(df: DataFrame, row_id: str, seed: str, n: int) -> DataFrame:
    """The first n rows of a seeded shuffle, numbered from 0 in that order. The n rows are
    the result, so numbering them in one task costs n rows."""
    order = [F.md5(F.concat(F.col(row_id).cast("string"), F.lit(seed))), F.col(row_id)]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("seq", (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))


def already_judged_filter(df: DataFrame, judged: DataFrame, row_id: str, key: str) -> DataFrame:
    """Drops rows whose id or whose text key was judged before."""
    return df.join(judged.select(row_id), row_id, "left_anti").join(
        judged.select(key).distinct(), key, "left_anti"
    )


def funnel_status(df: DataFrame, key: str, row_id: str, text: str, refs, min_len: int) -> DataFrame:
    """Adds `status`: empty, dup_within, dup_vs_<tag> or kept.

    A key found in a reference is not marked as seen, so all its copies count against the
    reference; of any other key the first row is kept and the later ones are dup_within.
    Firsts are found by partial aggregation and joined back on the row id, never on the key,
    so a key with very many copies gives no heavy task.
    """
    usable = F.length(F.trim(text)) >= min_len
    flagged = df.withColumn("_ok", usable)
    firsts = first_ids(flagged.filter("_ok"), key, row_id)
    marks = firsts.select(row_id, key).withColumn("_first", F.lit(True))
    hits = flagged.filter("_ok").select(key).distinct().join(union_refs(refs, key), key)
    tagged = flagged.join(marks.select(row_id, "_first"), row_id, "left").join(hits, key, "left")
    return tagged.withColumn(
        "status",
        F.when(~F.col("_ok"), "empty")
        .when(F.col("ref_tag").isNotNull(), F.concat(F.lit("dup_vs_"), "ref_tag"))
        .when(F.col("_first"), "kept")
        .otherwise("dup_within"),
    ).drop("_ok", "_first", "ref_tag")


def funnel_counts(df: DataFrame, status: str, family: str) -> DataFrame:
    """Rows per status, for each family and in all (family '*')."""
    return (
        df.rollup(F.col(status), F.col(family)).agg(F.count("*").alias("n"))
        .filter(F.col(status).isNotNull())
        .select(F.col(status), F.coalesce(F.col(family), F.lit("*")).alias("family"), "n")
    )


def funnel_counts_by_key(df: DataFrame, key: str, row_id: str, text: str, refs, min_len: int, family: str) -> DataFrame:
    """The counts of `funnel_status` (unique row ids) without a row per row: rows are counted per key, family and use by
    partial aggregation first, so what meets the references and the firsts is at most one row per key and family,
    however many copies a key has. A null text is empty, a null key equals itself but no reference, a null family is `?`."""
    usable = F.coalesce(F.length(F.trim(text)) >= min_len, F.lit(False))
    per = df.groupBy(F.col(key).alias("_key"), F.coalesce(F.col(family).cast("string"), F.lit("?")).alias("family"), usable.alias("_ok")).agg(
        F.count("*").alias("n"), F.min(row_id).alias("_id"))
    good = per.filter("_ok")
    firsts = first_ids(good, "_key", "_id").select(F.col("_key").alias("_of"), F.col("_id").alias("_first"))
    met = good.join(firsts, F.col("_key").eqNullSafe(F.col("_of"))).join(union_refs(refs, key).withColumnRenamed(key, "_of2"), F.col("_key") == F.col("_of2"), "left")
    kept = (F.col("_id") == F.col("_first")).cast("long")

    def some(status, n):
        return F.struct(status.alias("status"), n.alias("n"))

    new = F.array(some(F.lit("kept"), kept), some(F.lit("dup_within"), F.col("n") - kept))
    parts = F.when(F.col("ref_tag").isNull(), new).otherwise(F.array(some(F.concat(F.lit("dup_vs_"), "ref_tag"), F.col("n"))))
    rows = met.select("family", F.explode(parts).alias("s")).select("s.status", "family", "s.n").filter("n > 0").unionByName(
        per.filter("NOT _ok").select(F.lit("empty").alias("status"), "family", "n"))
    return rows.rollup("status", "family").agg(F.sum("n").alias("n")).filter("status IS NOT NULL").withColumn("family", F.coalesce("family", F.lit("*")))


def similarity_percentiles(df: DataFrame, col: str, ps=(0.5, 0.9, 0.99)) -> DataFrame:
    names = {f"p{round(p * 100)}": p for p in ps}
    return exact_percentiles(df, col, names).select(*names)


# --- n-gram near duplicates ------------------------------------------------------------

BLOCK = 2048  # gram sets of a side that are multiplied at once
COLUMNS = 2048  # commonest grams that are multiplied
FEW = 768  # of them that are multiplied first
EXTRA = 2048  # columns beyond, multiplied where more than a share MANY of a part's pairs is left
MANY = 0.1
BITS = 1 << 15  # grams after COLUMNS, which are compared as bits; the rest is counted one by one
PAIRS = 2048  # pairs whose bits are compared at once
PART = 512  # sets of a side whose other columns are multiplied together
MEETINGS = 16  # reference blocks that a row of the plan names at most
STEPS = 4  # bands within a factor t of sizes
TASKS = 4096  # that the plan is dealt to at most
HELD = 32 << 20  # bytes of gram sets that a task holds before it writes files


def near_dup_ngram(q: DataFrame, ref: DataFrame, row_id: str, text: str, t: float, n: int = 3, block: int = None) -> DataFrame:
    """For each row of `q` with a neighbour in `ref` of n-gram Jaccard > t: the greatest
    Jaccard and the nearest id (least id among equals). Exact.

    Equal texts are collapsed to one representative on both sides first, so a mass of copies costs one. A pair over t has
    sizes within a factor t, so sets are dealt to bands of sizes, STEPS of them within 1/t, and meet only bands so near.
    Every set is written once, to a file of its band in the shared folder; which files meet is a small plan, and a task reads
    what its row names, a block at a time. So the disk taken is that of the sets, however many blocks meet.

    A task takes a block of query sets through several reference blocks and keeps each query's best so far: a pair is out as soon as
    it could not beat that even if all of the smaller rest were common. The commonest grams of the query block are counted by
    products of 0/1 matrices, a few columns for all pairs and the others where a part of the block has pairs left; what remains is
    counted by bits. No pair is a row: a query set gives its best partner.
    """
    block, spark = block or BLOCK, q.sparkSession
    q_sets, r_sets = (_gram_files(df, row_id, text, n, t, block) for df in (q, ref))
    files = [{}, {}]
    for side, df in zip(files, (q_sets, r_sets)):
        for r in df.groupBy("band", "file").agg(F.count("*").alias("n")).orderBy("band", "file").collect():  # one row per block
            side.setdefault(r["band"], []).append((r["file"], r["n"]))
    plan = []
    for band, mine in files[0].items():
        others = _blocks([f for k in range(band - STEPS, band + STEPS + 1) for f in files[1].get(k, [])], block)
        plan += [(a, others) for a in _blocks(mine, block)]
    meet = max(1, min(MEETINGS, sum(len(others) for _, others in plan) // (4 * spark.sparkContext.defaultParallelism)))
    plan = [(a, others[i:i + meet]) for a, others in plan for i in range(0, len(others), meet)]
    if not plan:
        return q.select(F.col(row_id).alias("id"), F.lit(0.0).alias("max_jac"), F.col(row_id).alias("nn_jac")).limit(0)

    def run(batches):
        for b in batches:
            for mine, others in zip(b["q"].to_pylist(), b["r"].to_pylist()):
                yield from _best_partners(_read_sets(mine), map(_read_sets, others), t).to_batches()

    rows = spark.createDataFrame(spark.sparkContext.parallelize(plan, min(len(plan), TASKS)), "q array<string>, r array<array<string>>")
    parts = rows.mapInArrow(run, "q_rep long, jac double, r_rep long")
    best = (
        parts.groupBy("q_rep").agg(F.max(F.struct("jac", (-F.col("r_rep")).alias("neg"))).alias("b"))
        .select(F.col("q_rep").alias("rep"), F.col("b.jac").alias("max_jac"), (-F.col("b.neg")).alias("nn_jac"))
    )
    members = _signed(q, row_id, text).select("id", "sign")
    return best.join(q_sets.select("rep", "sign"), "rep").join(members, "sign").select("id", "max_jac", "nn_jac")


def _signed(df: DataFrame, row_id: str, text: str) -> DataFrame:
    rows = once(df.select(F.col(row_id).alias("id"), F.col(text).alias("s")), s=squeezed(F.col("s")))
    return rows.filter("s IS NOT NULL").withColumn("sign", F.sha2("s", 256))


def _gram_files(df: DataFrame, row_id: str, text: str, n: int, t: float, block: int) -> DataFrame:
    """(rep, sign, band, file): of equal texts the least row id, with the file its gram set was written to."""
    reps = _signed(df, row_id, text).groupBy("sign").agg(F.min("id").alias("rep"), F.first("s").alias("s"))
    sets = reps if n <= 3 else reps.select("rep", "sign", char_ngrams(F.col("s"), n).alias("grams"))
    folder, ratio = scratch_path(df.sparkSession, "grams"), math.log(1 / t) / STEPS

    def save(batches):
        make_folder(folder)
        held, size = {}, {}

        def flush(band):
            table = pa.Table.from_batches(held.pop(band))
            del size[band]
            path = f"{folder}/{band}-{uuid.uuid4().hex}"
            with open_path(path, "wb") as f, pa.ipc.new_stream(f, table.schema.remove(1), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.remove_column(1))
            file = pa.array([path] * len(table), pa.string())
            return pa.table({"rep": table["rep"], "sign": table["sign"], "band": pa.array([band] * len(table), pa.int32()), "file": file}).to_batches()

        for b in batches:
            if n <= 3:
                b = pa.RecordBatch.from_arrays([b["rep"], b["sign"], _packed(b["s"], n)], names=["rep", "sign", "grams"])
            sizes = pc.list_value_length(b["grams"]).to_numpy(zero_copy_only=False)
            bands = np.floor(np.log(np.maximum(1, sizes)) / ratio + 1e-9).astype(int)
            for band in np.unique(bands).tolist():
                part = b.take(pa.array(np.flatnonzero(bands == band)))
                for lo in range(0, part.num_rows, block):
                    piece = part.slice(lo, block)
                    held.setdefault(band, []).append(piece)
                    rows, kept = size.get(band, (0, 0))
                    size[band] = rows + piece.num_rows, kept + 8 * int(pc.sum(pc.list_value_length(piece["grams"])).as_py())
                    if size[band][0] >= block:
                        yield from flush(band)
            while sum(k for _, k in size.values()) > HELD:
                yield from flush(max(size, key=lambda k: size[k][1]))
        for band in list(held):
            yield from flush(band)

    return stored(sets.mapInArrow(save, "rep long, sign string, band int, file string"), "gram-files")


def _packed(texts: pa.Array, n: int) -> pa.Array:
    """The distinct n-grams (n up to 3) of each text, 21 bits a character; a shorter text is its only gram."""
    sets = []
    for s in texts:
        codes = np.frombuffer(s.as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(codes) < n:
            codes = np.r_[codes, np.zeros(n - len(codes), np.int64)]
        packed = codes[:len(codes) - n + 1]
        for i in range(1, n):
            packed = (packed << 21) | codes[i:len(codes) - n + 1 + i]
        sets.append(np.unique(packed))
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def _blocks(files: list[tuple[str, int]], block: int) -> list[list[str]]:
    """Files put together until they hold `block` sets."""
    out, room = [], 0
    for file, n in files:
        if n > room:
            out.append([])
            room = block
        out[-1].append(file)
        room -= n
    return out


def _read_sets(files: list[str]):
    """Ids, sizes, the row of every gram, and the grams."""
    tables = []
    for file in files:
        with open_path(file, "rb") as f:
            tables.append(pa.ipc.open_stream(f.read()).read_all())
    table = pa.concat_tables(tables).combine_chunks()
    lists = table["grams"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["rep"].to_numpy(), sizes, np.repeat(np.arange(len(sizes)), sizes), lists.flatten()


class _Side:
    """Sets of a block as columns, bits and a rest, by the ranks that the query block gave its grams. Grams that it does
    not have are left out; they count in the sizes only. Sets lie beside those that are nearest to the same anchor."""

    def __init__(self, sets, ranks: np.ndarray, anchors=None):
        self.ids, self.sizes, rows, _ = sets
        rows, ranks = rows[ranks >= 0], ranks[ranks >= 0]
        n, early, late = len(self.ids), ranks < COLUMNS, ranks >= COLUMNS + BITS
        self.cols = np.zeros((n, COLUMNS + EXTRA), np.float32)
        wide = ranks < COLUMNS + EXTRA
        self.cols[rows[wide], ranks[wide]] = 1
        mid = ~(early | late)
        words = max(1, -(-(int(ranks[mid].max(initial=COLUMNS - 1)) + 1 - COLUMNS) // 64))
        self.bits = np.zeros((n, words), np.uint64)
        np.add.at(self.bits, (rows[mid], (ranks[mid] - COLUMNS) // 64), np.uint64(1) << ((ranks[mid] - COLUMNS) % 64).astype(np.uint64))
        count = np.bincount(rows[late], minlength=n)
        self.rest, starts = ranks[late], np.r_[0, np.cumsum(count)]
        few = min(FEW, COLUMNS)
        left = [np.bincount(rows[ranks >= c], minlength=n).astype(np.float32) for c in (few, COLUMNS, COLUMNS + EXTRA)]
        self.anchors = self.cols[:: max(1, n // 8), :few].T.copy() if anchors is None else anchors
        like = self.cols[:, :few] @ self.anchors / (self.sizes[:, None] + self.anchors.sum(0))
        order = np.lexsort((self.sizes, like.argmax(1)))
        self.ids, self.sizes, self.cols, self.bits = (x[order] for x in (self.ids, self.sizes, self.cols, self.bits))
        self.left = [x[order] for x in left]  # grams after the columns of each stage
        self.starts, self.ends = starts[:-1][order], starts[1:][order]

    def tail(self, i: int) -> np.ndarray:
        return self.rest[self.starts[i]:self.ends[i]]


def _best_partners(left, blocks, t: float) -> pa.Table:
    """(q_rep, jac, r_rep): of every query set its best partner over t in the reference blocks."""
    coded = left[3].dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-np.bincount(codes, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    q, first = _Side(left, rank[codes]), min(FEW, COLUMNS)
    best, partner = np.zeros(len(q.ids)), np.full(len(q.ids), np.iinfo(np.int64).max)
    held = np.zeros(len(rank), bool)

    def keep(rows, cols, r, early, stage=1):
        """Tries pairs, `early` of whose columns up to the stage are common."""
        skip = EXTRA // 64 if stage > 1 else 0
        width = min(q.bits.shape[1], r.bits.shape[1])
        for lo in range(0, len(rows), PAIRS):
            i, j = rows[lo:lo + PAIRS], cols[lo:lo + PAIRS]
            both = early[lo:lo + PAIRS].astype(np.float64) + np.bitwise_count(q.bits[i, skip:width] & r.bits[j, skip:width]).sum(1)
            if len(r.rest):
                for at in np.flatnonzero((q.ends - q.starts)[i] * (r.ends - r.starts)[j]):
                    both[at] += len(np.intersect1d(q.tail(i[at]), r.tail(j[at]), assume_unique=True))
            jac = both / np.maximum(1, q.sizes[i] + r.sizes[j] - both)
            order = np.lexsort((r.ids[j], -jac, i))
            order = order[np.r_[True, i[order][1:] != i[order][:-1]]]  # the best of each query: of equals the least id
            i, jac, ids = i[order], jac[order], r.ids[j[order]]
            better = (jac >= t) & ((jac > best[i]) | (jac == best[i]) & (ids < partner[i]))
            best[i[better]], partner[i[better]] = jac[better], ids[better]

    def could(some, mine, others, r, stage):
        """Which pairs with `some` in common up to the stage may still reach the best of their query."""
        least = np.maximum(best[mine], t)
        share = (least / (1 + least) * (1 - 1e-6)).astype(np.float32)  # of both sizes that is in common at that Jaccard
        high = np.minimum(q.left[stage][mine, None], r.left[stage][others])
        high += some
        high -= share[:, None] * r.sizes[others].astype(np.float32)
        return high > (share * q.sizes[mine] - 0.05)[:, None]

    for block in blocks:
        at = pc.fill_null(pc.index_in(block[3], value_set=words), -1).to_numpy(zero_copy_only=False)
        r = _Side(block, np.where(at < 0, -1, rank[at]), q.anchors)
        few = q.cols[:, :first] @ r.cols[:, :first].T  # whole numbers below 2^24
        sizes = r.sizes.astype(np.float32)
        for lo in range(0, len(q.ids), PART):
            mine = slice(lo, lo + PART)
            likely = (few[mine] / (sizes + q.sizes[mine, None].astype(np.float32))).argmax(1)  # tried first, so that few others are left
            rows = np.arange(lo, lo + len(likely))
            keep(rows, likely, r, np.einsum("ij,ij->i", q.cols[rows, :COLUMNS], r.cols[likely, :COLUMNS]))
            for at in range(0, len(r.ids), PART):
                others, stage = slice(at, at + PART), 1
                part = few[mine, others]
                if not could(part, mine, others, r, 0).any():
                    continue
                part = part + q.cols[mine, first:COLUMNS] @ r.cols[others, first:COLUMNS].T
                open_ = could(part, mine, others, r, 1)
                if open_.mean() > MANY:
                    part += q.cols[mine, COLUMNS:] @ r.cols[others, COLUMNS:].T
                    stage = 2
                    open_ = could(part, mine, others, r, 2)
                rows = np.flatnonzero(open_.any(1))
                if open_.sum() > 2 * len(rows):
                    likely = (part[rows] / (sizes[others] + q.sizes[mine][rows, None])).argmax(1)
                    keep(lo + rows, at + likely, r, part[rows, likely], stage)
                    open_ = could(part, mine, others, r, stage)
                rows, cols = np.nonzero(open_)
                keep(lo + rows, at + cols, r, part[rows, cols], stage)
    found = best > t
    return pa.table({"q_rep": pa.array(q.ids[found], pa.int64()), "jac": pa.array(best[found], pa.float64()), "r_rep": pa.array(partner[found], pa.int64())})


def near_dup_report(ids: DataFrame, cos: DataFrame, jac: DataFrame, cos_t: float, jac_t: float) -> DataFrame:
    """Why a row is removed: cosine first, then n-grams; the nearest row by that measure."""
    joined = ids.join(cos, "id", "left").join(jac, "id", "left")
    by_cos, by_jac = F.col("max_cos") > cos_t, F.col("max_jac") > jac_t
    return joined.withColumn("reason", F.when(by_cos, "cos").when(by_jac, "jacc").otherwise("kept")).withColumn(
        "nearest", F.when(by_cos, F.col("nn_cos")).when(by_jac, F.col("nn_jac"))
    )
