"""Similarity between vector tables by matrix blocks, and operators built on it.

Expressions over arrays compare one pair of vectors per row. The operators here compare
blocks: a matrix product of a batch of queries with a block of references, reduced inside
the task (to a maximum, a count, a sum) before anything is sent on. No pair is ever a row.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.ranking import exact_percentiles
from ..functions.vectors import cosine

BROADCAST_BYTES = 64 << 20   # largest reference side sent whole to every task
BLOCK_ROWS = 32768           # rows per block when both sides are large
CELLS = 1 << 20              # largest similarity matrix held at once, in entries
QUERIES = 32                 # but so many queries at least: narrower products are slow
STRETCH = 2048               # references of a label compared at once in single precision
TIE = 1e-12
DIGITS = 12                  # similarities equal to so many digits are ties


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrow list column -> matrix of unit rows in double."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(arr) == 0:
        return np.zeros((0, 1))
    m = np.asarray(arr.flatten(), dtype=np.float64).reshape(len(arr), -1)
    return over_norm(m)


def over_norm(m: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row stays zero, so it is similar to nothing."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _side(t, order=("id",)) -> tuple[pd.DataFrame, np.ndarray]:
    """Columns other than the vector, and the vectors, in order of the columns named, and `by_id`, the places in id order.
    Rows without a vector are left out."""
    t = pa.table(t) if not isinstance(t, pa.Table) else t
    t = t.filter(t["vec"].is_valid()).sort_by([(c, "ascending") for c in order])
    x = t.drop_columns(["vec"]).to_pandas()
    return x.assign(by_id=np.argsort(x["id"].to_numpy(), kind="stable")), unit_rows(t["vec"])


def _run_block(q, r, fn, schema: pa.Schema):
    qx, qm = q
    rx, rm = r
    step = max(QUERIES, CELLS // max(1, len(rx)))
    for i in range(0, len(qx), step):
        part = qx.iloc[i:i + step].reset_index(drop=True)
        out = fn(part, rx, qm[i:i + step] @ rm.T)
        yield pa.Table.from_pandas(out, schema=schema, preserve_index=False)


def block_apply(q: DataFrame, ref: DataFrame, fn, schema: str, broadcast_bytes=None, block_rows=None, order=("id",), run=_run_block) -> DataFrame:
    """fn(query columns, reference columns, similarities) -> partial rows, over all blocks.

    Both sides have `id` and `vec` and any further columns fn needs; references come in order of the columns named. A reference side whose
    size is checked to be small goes to every task and the queries stay where they are.
    Otherwise both sides are cut into hash blocks and each pair of blocks meets in its own
    task, which holds two blocks whatever the sizes of the tables. `run` makes the partial rows of two sides from fn.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    rows = BLOCK_ROWS if block_rows is None else block_rows
    spark = q.sparkSession
    out = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    n, dim = ref.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n * ((dim or 0) * 8 + 128) <= limit:
        shared = spark.sparkContext.broadcast(ref.toArrow())

        def scan(batches):
            r = _side(shared.value, order)
            for b in batches:
                if b.num_rows:
                    for t in run(_side(pa.Table.from_batches([b])), r, fn, arrow):
                        yield from t.to_batches()

        return q.mapInArrow(scan, out)

    nr = -(-n // rows)
    nq = max(1, -(-q.count() // rows))

    def place(df, own, own_n, other, other_n):
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    left = place(q, "qb", nq, "rb", nr)
    # both sides may come from one table: the aliases tell their columns apart
    right = place(ref.select(*[F.col(c).alias(c) for c in ref.columns]), "rb", nr, "qb", nq)

    def meet(lt, rt):
        if lt.num_rows == 0 or rt.num_rows == 0:
            return arrow.empty_table()
        sides = _side(lt.drop_columns(["qb", "rb"])), _side(rt.drop_columns(["qb", "rb"]), order)
        return pa.concat_tables([arrow.empty_table(), *run(*sides, fn, arrow)])

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, out)


def _same(values, rx) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) where a row's value equals a reference's id; ids may repeat."""
    ids, by_id, values = rx["id"].to_numpy(), rx["by_id"].to_numpy(), np.asarray(values)
    lo, hi = (np.searchsorted(ids, values, side, sorter=by_id) for side in ("left", "right"))
    n = np.where(values == values, hi - lo, 0)
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(n)), n), by_id[at]


def _ignore(qx, rx, s, skip_self, skip_same, mask_at, value) -> None:
    """Puts `value` where a similarity does not count."""
    if mask_at is not None:
        s[s >= mask_at] = value
    if skip_same:
        s[qx[skip_same].to_numpy()[:, None] == rx[skip_same].to_numpy()[None, :]] = value
    if skip_self:
        s[_same(qx["id"], rx)] = value


def nearest(q: DataFrame, ref: DataFrame, skip_self=False, skip_same=None, mask_at=None, **sizes) -> DataFrame:
    """(id, max_cos, nn): the greatest similarity and the least id that reaches it to `DIGITS` digits. The
    answer does not depend on how the references are cut into blocks.

    skip_self ignores the query's own id, skip_same ignores references with an equal value in
    the named column (a fold), mask_at ignores similarities from that value up as matches of
    the text with itself. Without a reference left both are null. A zero vector has similarity 0 with
    all; rows without a vector are left out.
    """
    cols = ["id", "vec"] + ([skip_same] if skip_same else [])

    def fn(qx, rx, s):
        _ignore(qx, rx, s, skip_self, skip_same, mask_at, -np.inf)
        level = np.round(s, DIGITS)
        best = level.max(axis=1)
        at = (level == best[:, None]).argmax(axis=1)
        some = np.isfinite(best)
        return pd.DataFrame({"id": qx["id"], "sim": s.max(axis=1), "level": best, "nn": rx["id"].to_numpy()[at]})[
            ["id", "sim", "level", "nn"]].assign(ok=some)

    parts = block_apply(q.select(cols), ref.select(cols), fn, "id bigint, sim double, level double, nn bigint, ok boolean", **sizes)
    best = F.max(F.when(F.col("ok"), F.struct("level", (-F.col("nn")).alias("neg"))))
    return parts.groupBy("id").agg(best.alias("b"), F.max(F.when(F.col("ok"), F.col("sim"))).alias("max_cos")).select(
        "id", "max_cos", (-F.col("b.neg")).alias("nn"))


def pair_similarity(q: DataFrame, ref: DataFrame, skip_self=False, **sizes) -> DataFrame:
    """Each query's row of the similarity matrix, summed up: n, mean, least and greatest."""

    def fn(qx, rx, s):
        keep = np.ones_like(s, bool)
        if skip_self:
            keep = qx["id"].to_numpy()[:, None] != rx["id"].to_numpy()[None, :]
        return pd.DataFrame({
            "id": qx["id"], "n": keep.sum(1), "s": np.where(keep, s, 0).sum(1),
            "lo": np.where(keep, s, np.inf).min(1), "hi": np.where(keep, s, -np.inf).max(1)})

    parts = block_apply(q.select("id", "vec"), ref.select("id", "vec"), fn,
                        "id bigint, n bigint, s double, lo double, hi double", **sizes)
    return parts.groupBy("id").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"),
                                   F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _best_per_label(q, r, skip_self: bool):
    """Labels, and each query's greatest similarity to each: -1 where a label has no other row than the query's own.
    Products in single precision, small enough for a core's cache, say which reference of a stretch of a label can be the
    greatest. It is compared in double, or the whole stretch is where others come too near."""
    (qx, qm), (rx, rm) = q, r
    names, starts = np.unique(rx["label"].to_numpy(), return_index=True)
    cuts = np.union1d(starts, np.arange(0, len(rx), STRETCH))
    slack = 2.1 * (rm.shape[1] + 3) * 2.0 ** -24  # twice what a single product of unit rows can be off
    small_q, small_r = qm.astype(np.float32), rm.astype(np.float32)
    own, at_own = _same(qx["id"], rx) if skip_self else (np.empty(0, int), np.empty(0, int))
    best = np.empty((len(qm), len(cuts)))
    for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(rx)])):
        here = (at_own >= a) & (at_own < z)
        mine, place = own[here], at_own[here] - a
        for i in range(0, len(qm), QUERIES * 8):
            s = small_q[i:i + QUERIES * 8] @ small_r[a:z].T
            masked = (mine >= i) & (mine < i + len(s))
            s[mine[masked] - i, place[masked]] = -2
            rows, at = np.arange(len(s)), s.argmax(1)
            top = s[rows, at]
            out = np.einsum("ij,ij->i", qm[i:i + len(s)], rm[a + at])
            s[rows, at] = -2
            near = np.flatnonzero(s.max(1) >= np.where(top < -1.5, 2, top - slack))
            if len(near):
                s[near, at[near]] = top[near]
                whole = qm[i + near] @ rm[a:z].T
                whole[s[near] < -1.5] = -1
                out[near] = whole.max(1)
            out[top < -1.5] = -1
            best[i:i + len(s), k] = out
    return names, np.maximum.reduceat(best, np.searchsorted(cuts, starts), axis=1)


def max_sim_per_label(q: DataFrame, anchors: DataFrame, skip_self=False, mask_at=None, **sizes) -> DataFrame:
    """(id, label, sim): the greatest similarity to any anchor of each label."""

    def fn(qx, rx, s):
        _ignore(qx, rx, s, skip_self, None, mask_at, -1.0)
        names, starts = np.unique(rx["label"].to_numpy(), return_index=True)
        best = np.maximum.reduceat(s, starts, axis=1)
        return pd.DataFrame({"id": np.repeat(qx["id"].to_numpy(), len(names)),
                             "label": np.tile(names, len(qx)), "sim": best.ravel()})

    def best(qs, rs, _, schema):
        if len(qs[0]) and len(rs[0]):
            names, sims = _best_per_label(qs, rs, skip_self)
            yield pa.Table.from_pandas(pd.DataFrame({
                "id": np.repeat(qs[0]["id"].to_numpy(), len(names)), "label": np.tile(names, len(sims)), "sim": sims.ravel()}),
                schema=schema, preserve_index=False)

    # a mask compares each similarity with a limit, for which single precision won't do
    parts = block_apply(q.select("id", "vec"), anchors.select("id", "vec", "label"), fn, "id bigint, label int, sim double",
                        order=("label", "id"), run=_run_block if mask_at is not None else best, **sizes)
    return parts.groupBy("id", "label").agg(F.max("sim").alias("sim"))


def top1_gap(scores: DataFrame) -> DataFrame:
    """From (id, label, sim): the best label (least among equals), its score and the gap to the second."""
    ranked = F.sort_array(F.collect_list(F.struct("sim", (-F.col("label")).alias("neg"))), asc=False)
    return scores.groupBy("id").agg(ranked.alias("r")).select(
        "id", (-F.col("r")[0]["neg"]).alias("top_label"), F.col("r")[0]["sim"].alias("top"),
        (F.col("r")[0]["sim"] - F.col("r")[1]["sim"]).alias("gap"))


def anchor_features(scores: DataFrame) -> DataFrame:
    """(id, features): the per-label similarities as an array in label order."""
    return scores.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "sim"))), lambda x: x["sim"]).alias("features"))


def near_dup_cosine(q: DataFrame, ref: DataFrame, t: float = 0.95, **sizes) -> DataFrame:
    """Nearest reference of each row, and whether it is close enough to drop the row."""
    return nearest(q, ref, **sizes).withColumn("dropped", F.col("max_cos") > t)


def leak_guard(train: DataFrame, test: DataFrame, t: float = 0.92, **sizes) -> DataFrame:
    """Training rows not too close to any test row."""
    close = nearest(train, test, **sizes).filter(F.col("max_cos") > t).select("id")
    return train.join(close, "id", "left_anti")


def rank_of_gold(q: DataFrame, docs: DataFrame, gold: DataFrame, **sizes) -> DataFrame:
    """(id, rank): 1 + the number of documents scoring strictly higher than the gold one.
    `gold` maps id to gold_id. Counting needs no sort."""
    g = docs.select(F.col("id").alias("gold_id"), F.col("vec").alias("gold_vec"))
    scored = q.join(gold, "id").join(g, "gold_id").select(
        "id", "vec", "gold_id", cosine(F.col("vec"), F.col("gold_vec")).alias("gold_sim"))

    def fn(qx, rx, s):
        higher = s > qx["gold_sim"].to_numpy()[:, None] + TIE
        for own in ("id", "gold_id"):
            higher[_same(qx[own], rx)] = False
        return pd.DataFrame({"id": qx["id"], "higher": higher.sum(1)})

    parts = block_apply(scored, docs.select("id", "vec"), fn, "id bigint, higher bigint", **sizes)
    return parts.groupBy("id").agg((F.sum("higher") + 1).alias("rank"))


# --- catalogues: few candidates with a checked size ---------------------------------------------

def centroids(df: DataFrame) -> DataFrame:
    """(label, vec): the mean vector of each label."""
    means = df.select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy("label").agg(arr.alias("vec"))


def catalogue_matrix(catalogue: DataFrame, key: str) -> tuple[list, np.ndarray]:
    """Names and vectors of a catalogue in key order: the weights that go to every task."""
    t = catalogue.select(key, "vec").toArrow().sort_by(key)
    vals = np.asarray(t["vec"].combine_chunks().flatten(), dtype=np.float64)
    return t[key].to_pylist(), vals.reshape(t.num_rows, -1)


def cosines_to(matrix: np.ndarray):
    """A column function: the cosines of a vector to every row of the matrix, as an array."""
    unit = over_norm(matrix)

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, unit.shape[1]))
        return pd.Series(list(over_norm(m) @ unit.T))

    return score


def candidate_join(tasks: DataFrame, catalogue: DataFrame, key: str) -> tuple[DataFrame, list]:
    """Adds `cos`, one similarity per catalogue entry in key order; also gives that order."""
    names, matrix = catalogue_matrix(catalogue, key)
    return tasks.withColumn("cos", cosines_to(matrix)("vec")), names


def variant_mean(cols: list[str]) -> Column:
    """Element-wise mean of several score arrays."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(cols))


# --- whole-table facts ----------------------------------------------------------------------------

def fit_standardize(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: mean and spread (population standard deviation + eps) of each dimension."""
    per_dim = df.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(
        F.avg("x").alias("m"), (F.stddev_pop("x") + eps).alias("s"))
    arr = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
    return per_dim.agg(arr.alias("a")).select(
        F.struct(F.transform("a", lambda x: x["m"]).alias("mean"), F.transform("a", lambda x: x["s"]).alias("sd")).alias("fit"))


def apply_standardize(df: DataFrame, fit: DataFrame) -> DataFrame:
    fitted = df.withColumn("_fit", fit.scalar())
    centred = F.zip_with("vec", F.col("_fit.mean"), lambda x, m: x.cast("double") - m)
    return fitted.withColumn("vec", F.zip_with(centred, F.col("_fit.sd"), lambda x, s: x / s)).drop("_fit")


def concat_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Second vectors appended to first ones of the same id; an id without partner is an error."""
    other = b.select("id", F.col("vec").alias("_v2"))
    joined = a.join(other, "id", "left")
    both = F.concat(F.col("vec").cast("array<double>"), F.col("_v2").cast("array<double>"))
    complain = F.raise_error(F.concat(F.lit("no second vector for "), F.col("id").cast("string")))
    return joined.withColumn("vec", F.when(F.col("_v2").isNotNull(), both).otherwise(complain)).drop("_v2")


def quantile_map(a: DataFrame, b: DataFrame, score: str, quantiles: list[float]) -> DataFrame:
    """The straight line through matching quantiles of two score tables: a ~ slope * b + shift."""
    names = {f"q{i}": q for i, q in enumerate(quantiles)}

    def points(df, out):
        row = exact_percentiles(df, score, names)
        return row.select(F.posexplode(F.array(*names)).alias("i", out))

    return points(a, "qa").join(points(b, "qb"), "i").agg(
        F.regr_slope("qa", "qb").alias("slope"), F.regr_intercept("qa", "qb").alias("shift"))


def vector_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, cos) between two dumps of the same ids."""
    return a.join(b.select("id", F.col("vec").alias("_v2")), "id").select("id", cosine(F.col("vec"), F.col("_v2")).alias("cos"))


def drift_summary(drift: DataFrame) -> DataFrame:
    ps = exact_percentiles(drift, "cos", {"p01": 0.01, "p05": 0.05, "median": 0.5})
    rest = drift.agg(
        F.avg("cos").alias("mean"), F.min("cos").alias("lo"),
        F.count_if(F.col("cos") < 0.999).alias("below_999"), F.count_if(F.col("cos") < 0.9995).alias("below_9995"))
    return rest.withColumn("_p", ps.select(F.struct("n", "p01", "p05", "median")).scalar()).select(
        "mean", "lo", "below_999", "below_9995", "_p.*")


def drift_worst(drift: DataFrame, n: int = 5) -> DataFrame:
    return drift.orderBy("cos", "id").limit(n)
