"""Evaluation aggregates. Inputs carry gold and predicted labels, confidence, and the flags
`ok` (correct under the label rules) and `sens` (a sensitive label was predicted)."""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import cumulate, exact_percentiles, with_cell
from ..functions.rules import accept, count_if, ratio, share, to_bands


def classification_summary(df: DataFrame, tau: float, tau_s: float, by=(), top3: Column | None = None) -> DataFrame:
    a = accept(F.col("conf"), F.col("sens"), tau, tau_s)
    fe = F.col("sens") & (F.col("pred") != F.col("label"))
    cols = [
        F.count("*").alias("n"), share(F.col("ok")).alias("top1"), share(a).alias("coverage"),
        ratio(count_if(a & F.col("ok")), count_if(a)).alias("selective_acc"),
        count_if(a & fe).alias("fe_accepted"), count_if(fe).alias("fe_any"),
    ]
    if top3 is not None:
        cols.append(share(top3).alias("top3"))
    return df.groupBy(*by).agg(*cols)


def _binned(df: DataFrame, bins: int) -> DataFrame:
    """Right-closed bins (lo, lo + 1/bins]; a confidence of 0 is in none."""
    b = F.ceil(F.col("conf") * bins).cast("int")
    return df.filter("conf > 0").groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), share(F.col("ok")).alias("acc"), F.avg("conf").alias("mean_conf"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over all rows."""
    total = df.agg(F.count("*")).scalar()
    per = _binned(df, bins)
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean_conf")))).alias("e")).select(
        (F.col("e") / total).alias("ece"))


def reliability_bins(df: DataFrame, bins: int = 10, min_n: int = 5) -> DataFrame:
    return _binned(df, bins).filter(F.col("n") >= min_n)


def sliced_accuracy(df: DataFrame, dims: list[str], crossed: list[tuple] = ()) -> DataFrame:
    """Rows and accuracy for each value of each dimension, and for given combinations, in
    one pass over the data."""
    slices = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]
    slices += [
        F.struct(F.lit("x".join(c)).alias("dim"), F.concat_ws("/", *[F.col(x).cast("string") for x in c]).alias("value"))
        for c in crossed
    ]
    return df.select("ok", F.explode(F.array(*slices)).alias("s")).groupBy("s.dim", "s.value").agg(
        F.count("*").alias("n"), share(F.col("ok")).alias("acc"))


def binned_accuracy(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Accuracy by how many edges the value has reached."""
    b = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.col(col) >= e))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), share(F.col("ok")).alias("acc"))


def top_confusions(df: DataFrame, n: int, sensitive_only: bool = False) -> DataFrame:
    wrong = df.filter(~F.col("ok"))
    if sensitive_only:
        wrong = wrong.filter("sens")
    return wrong.groupBy("label", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "pred").limit(n)


def auc(df: DataFrame, score: str, positive: Column, by=(), weight: Column | None = None) -> DataFrame:
    """Mann-Whitney AUC per group, tied scores counting half; groups with one class only are
    left out. Rows are first counted per distinct score, so ties cost nothing and the
    running sums see each score once."""
    w = F.lit(1) if weight is None else weight
    per = df.groupBy(*by, score).agg(
        F.sum(F.when(positive, w).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(w)).alias("neg"))
    c = cumulate(per, by, score, ["pos", "neg"])
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return c.groupBy(*by).agg(
        F.first("pos_all").alias("n_pos"), F.first("neg_all").alias("n_neg"), F.sum(won).alias("_w")
    ).filter("n_pos > 0 and n_neg > 0").withColumn("auc", F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).drop("_w")


def latency_percentiles(df: DataFrame, ms: str, slices: dict[str, Column]) -> DataFrame:
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()])
    each = df.select(F.col(ms).alias("ms"), F.explode(F.array_compact(arr)).alias("slice"))
    return exact_percentiles(each, "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["slice"])


# --- bootstrap -----------------------------------------------------------------------------
# Running probabilities of a Poisson(1) variable, P(X <= k), as far as 32-bit draws tell them apart.
POISSON1_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
                0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999364022]


class Draws:
    """How often rows are drawn in each of b replicates: the inverse of the Poisson(1) distribution at a uniform number
    from md5(seed-replicate-key). Every row decides its own draws, so nothing is joined and a recomputed task draws the
    same again; replicate sizes vary around n as in any Poisson bootstrap. A kernel holds ROWS x b of them."""

    ROWS = 512

    def __init__(self, seed: str, b: int):
        self.starts = [f"{seed}-{r}-".encode() for r in range(b)]

    def of(self, keys: list) -> np.ndarray:
        prefixes = [hashlib.md5(s) for s in self.starts]
        out = np.empty((len(keys), len(prefixes)), np.uint32)
        for i, key in enumerate(keys):
            tail = str(key).encode()
            row = bytearray()
            for p in prefixes:
                h = p.copy()
                h.update(tail)
                row += h.digest()[:4]
            out[i] = np.frombuffer(row, ">u4")
        return np.searchsorted(POISSON1_CDF, out / 2.0 ** 32, side="right").astype(np.float64)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to a fixed number of tasks: they are few bytes, so Spark would join the pieces of an exchange into one or
    two tasks, while every row costs b hashes."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def replicate_sums(df: DataFrame, key: str, b: int, seed: str, sums: dict[str, Column]) -> DataFrame:
    """(rep, sums...): for each replicate the sums of the given numbers over the drawn rows. A batch is a product of its
    draws with its numbers, and a task sends one row per replicate, whatever the number of its rows."""
    draws, names = Draws(seed, b), list(sums)
    schema = pa.schema([("rep", pa.int32()), *((n, pa.float64()) for n in names)])

    def run(batches):
        total = np.zeros((b, len(names)))
        for batch in batches:
            for lo in range(0, batch.num_rows, Draws.ROWS):
                part = batch.slice(lo, Draws.ROWS)
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], 1)
                total += draws.of(part.column(0).to_pylist()).T @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(b), pa.int32()), *(pa.array(c) for c in total.T)], schema=schema)

    given = df.select(F.col(key).cast("string"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    parts = _dealt(given, key).mapInArrow(run, "rep int, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def replicate_auc(df: DataFrame, key: str, score: str, positive: str, b: int, seed: str) -> DataFrame:
    """(rep, auc) of the drawn rows, replicates with one class left out. Scores are cut into ranges; a range sums for all
    replicates its positives, its negatives and the wins inside it, and the ranges are put together in order."""
    draws = Draws(seed, b)

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("s").combine_chunks()
        pos, neg, wins = np.zeros(b), np.zeros(b), np.zeros(b)
        tied_pos, tied_neg, last = np.zeros(b), np.zeros(b), None
        for lo in range(0, table.num_rows, Draws.ROWS):
            part = table.slice(lo, Draws.ROWS)
            w, y, s = draws.of(part["k"].to_pylist()), part["y"].to_numpy().astype(bool), part["s"].to_numpy()
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            p, n = np.add.reduceat(w * y[:, None], start), np.add.reduceat(w * ~y[:, None], start)
            if last is not None and s[0] == last:  # the chunk before ended inside a tie
                wins -= tied_pos * (neg - tied_neg + tied_neg / 2)
                pos, neg = pos - tied_pos, neg - tied_neg
                p[0], n[0] = p[0] + tied_pos, n[0] + tied_neg
            wins += (p * (neg + np.cumsum(n, 0) - n + n / 2)).sum(0)
            pos, neg = pos + p.sum(0), neg + n.sum(0)
            tied_pos, tied_neg, last = p[-1], n[-1], s[-1]
        cell = np.full(b, table["_cell"][0].as_py(), np.int32)
        return pa.table({"cell": cell, "rep": np.arange(b, dtype=np.int32), "pos": pos, "neg": neg, "wins": wins})

    given = df.select(F.col(key).cast("string").alias("k"), F.col(score).cast("double").alias("s"), F.col(positive).cast("int").alias("y"))
    given = with_cell(given.filter("s IS NOT NULL AND y IS NOT NULL"), "s")
    cells = _dealt(given, "_cell").groupBy("_cell").applyInArrow(inside, "cell int, rep int, pos double, neg double, wins double")
    before = F.coalesce(F.sum("neg").over(W.partitionBy("rep").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole = cells.withColumn("_b", before).groupBy("rep").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
                                                             F.sum(F.col("wins") + F.col("pos") * F.col("_b")).alias("w"))
    return whole.filter("p > 0 and n > 0").select("rep", (F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def percentile_interval(reps: DataFrame, value: str, lo: int, hi: int, by=()) -> DataFrame:
    """Elements number lo and hi (from 0) of the sorted replicate values; the values are one
    per replicate, a number set by the caller."""
    s = F.sort_array(F.collect_list(value))
    return reps.groupBy(*by).agg(s.alias("s")).select(
        *by, F.size("s").alias("replicates"), F.element_at("s", lo + 1).alias("lo"), F.element_at("s", hi + 1).alias("hi"))


def bootstrap_ci(df: DataFrame, key: str, sums: dict[str, Column], metric: Column, b: int, seed: str, lo: int, hi: int) -> DataFrame:
    """Interval of any metric made of sums over rows, an expression over their names: a mean, F1, MRR, band rates,
    balanced accuracy, or a difference of two."""
    return percentile_interval(replicate_sums(df, key, b, seed, sums).select(metric.alias("m")), "m", lo, hi)


def bootstrap_mean_ci(df: DataFrame, key: str, diff: Column, b: int, seed: str, lo: int, hi: int) -> DataFrame:
    """Interval of the mean paired difference."""
    return bootstrap_ci(df, key, {"n": F.lit(1), "d": diff}, F.col("d") / F.col("n"), b, seed, lo, hi)


def bootstrap_auc_diff_ci(df: DataFrame, key: str, a: str, b_score: str, positive: str, b: int, seed: str, lo: int, hi: int):
    """Interval of the difference of two scores' AUC over the same rows. Replicates with one
    class only are skipped."""
    first, second = (replicate_auc(df, key, c, positive, b, seed) for c in (a, b_score))
    both = first.join(second.withColumnRenamed("auc", "other"), "rep")
    return percentile_interval(both.select((F.col("auc") - F.col("other")).alias("d")), "d", lo, hi)


def paired_wins(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))


def band_rates(df: DataFrame, score: str, positive: Column, hi: Column, lo: Column) -> DataFrame:
    s = F.col(score)
    pos, neg = count_if(positive), count_if(~positive)
    low = (s >= 0) & (s < lo)
    return df.agg(
        ratio(count_if(positive & (s >= hi)), pos).alias("rel_high"), ratio(count_if(positive & low), pos).alias("rel_low"),
        ratio(count_if(~positive & low), neg).alias("un_low"), ratio(count_if(~positive & (s >= hi)), neg).alias("un_high"))


def miss_categories(df: DataFrame, declined: Column, head_ok: Column, dims: list[str]) -> DataFrame:
    """Wrong rows by kind: declined or wrongly accepted, and whether the head alone was right."""
    kind = F.concat(F.when(declined, "declined").otherwise("accepted-wrong"), F.lit("/"),
                    F.when(head_ok, "head-right").otherwise("head-wrong"))
    return df.filter(~F.col("ok")).groupBy(kind.alias("category"), *dims).agg(F.count("*").alias("n"))


def focus_labels(df: DataFrame, tau: float, tau_s: float, n: int) -> DataFrame:
    """Labels by (3 x wrongly accepted + declined) / rows, pooled over several heads' rows."""
    a = accept(F.col("conf"), F.col("sens"), tau, tau_s)
    score = (3 * F.count_if(a & ~F.col("ok")) + F.count_if(~a)) / F.greatest(F.lit(1), F.count("*"))
    return df.groupBy("label").agg(score.alias("score")).orderBy(F.desc("score"), "label").limit(n)


def focus_pairs(df: DataFrame, tau: float, tau_s: float, unknown, n_fe: int, n_conf: int) -> DataFrame:
    """The commonest accepted sensitive confusions, then the commonest confusions, each pair once."""
    a = accept(F.col("conf"), F.col("sens"), tau, tau_s)
    wrong = df.filter(~F.col("ok"))
    order = [F.desc("n"), "label", "pred"]
    per = wrong.groupBy("label", "pred").agg(F.count("*").alias("n"), F.count_if(a & F.col("sens")).alias("fe"))
    fe = per.filter("fe > 0").orderBy(F.desc("fe"), "label", "pred").limit(n_fe).select("label", "pred", F.lit(0).alias("src"))
    conf = per.filter((F.col("pred") != F.lit(unknown)) & (F.col("pred") != F.col("label"))).orderBy(*order).limit(n_conf)
    return fe.unionByName(conf.select("label", "pred", F.lit(1).alias("src"))).groupBy("label", "pred").agg(F.min("src").alias("src"))


def pooled_weighted(df: DataFrame, n: str, means: list[str], counts: list[str], by=()) -> DataFrame:
    """Fold results pooled: means weighted by rows, counts added."""
    return df.groupBy(*by).agg(
        F.sum(n).alias(n), *[(F.sum(F.col(n) * F.col(m)) / F.sum(n)).alias(m) for m in means],
        *[F.sum(c).alias(c) for c in counts])


def mean_sd_over_seeds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def shift_report(df: DataFrame, positive: Column, len_a: Column, len_b: Column, overlap: str) -> DataFrame:
    """Class balance, median lengths and mean overlap by class, as one row."""
    base = df.agg(
        F.count("*").alias("n"), share(positive).alias("pos_frac"),
        F.avg(F.when(positive, F.col(overlap))).alias("overlap_pos"), F.avg(F.when(~positive, F.col(overlap))).alias("overlap_neg"))
    for name, length in (("len_a_med", len_a), ("len_b_med", len_b)):
        med = exact_percentiles(df.select(length.cast("double").alias("v")), "v", {name: 0.5}).select(name)
        base = base.withColumn(name, med.scalar())
    return base


def shift_breakdown(df: DataFrame, positive: Column, lang: str, generator: str, overlap: str, cjk: Column) -> DataFrame:
    """Where a set of pairs differs from another, as (what, key, n, value): rows and share of positives per language and
    per generator, AUC of the overlap over all rows and per language (those with both classes), and rows without CJK
    signs with their share. Null keys are shown as `?`."""

    def counted(what, by):
        key = F.coalesce(F.col(by).cast("string"), F.lit("?"))
        return df.groupBy(F.lit(what).alias("what"), key.alias("key")).agg(F.count("*").alias("n"), share(positive).alias("value"))

    def ranked(what, by, key):
        return auc(df, overlap, positive, by).select(F.lit(what).alias("what"), key.alias("key"), (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"),
                                                     F.col("auc").alias("value"))

    plain = df.agg(count_if(~cjk).alias("n"), share(~cjk).alias("value")).select(F.lit("cjk").alias("what"), F.lit("none").alias("key"), "n", "value")
    parts = [counted("lang", lang), counted("gen", generator), ranked("auc", [], F.lit("all")),
             ranked("auc_lang", [lang], F.coalesce(F.col(lang).cast("string"), F.lit("?"))), plain]
    return reduce(DataFrame.unionByName, parts)


def band_flips(a: DataFrame, b: DataFrame, key: str, score: str, hi: float, lo: float) -> DataFrame:
    """Rows that change band between two dumps, the greatest score change, and percentiles of
    the distance to the nearer band edge."""
    j = a.select(key, F.col(score).alias("s1")).join(b.select(key, F.col(score).alias("s2")), key)
    margin = F.least(F.abs(F.col("s1") - hi), F.abs(F.col("s1") - lo))
    flips = j.agg(
        F.count_if(to_bands(F.col("s1"), hi, lo) != to_bands(F.col("s2"), hi, lo)).alias("flips"),
        F.max(F.abs(F.col("s1") - F.col("s2"))).alias("max_change"))
    m = exact_percentiles(j.select(margin.alias("m")), "m", {"margin_p05": 0.05, "margin_med": 0.5})
    return flips.withColumn("_m", m.select(F.struct("n", "margin_p05", "margin_med")).scalar()).select("flips", "max_change", "_m.*")


def layer_and_reason_counts(df: DataFrame, reasons: list[str]) -> DataFrame:
    """Rows per deciding layer, and rows whose reason contains each given text."""
    hits = [F.when(F.col("reason").contains(r), F.lit(f"reason:{r}")) for r in reasons]
    keys = F.array_compact(F.array(F.concat(F.lit("layer:"), F.col("layer").cast("string")), *hits))
    return df.select(F.explode(keys).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def policy_table(df: DataFrame, grid: list[dict], sens_gold: Column) -> DataFrame:
    """Coverage, accuracy, wrong accepted, sensitive false exposures and sensitive recall at
    each (tau, tau_s)."""
    from .calibrate import threshold_counts

    t = threshold_counts(df.withColumn("_sg", sens_gold), grid, extra=["_sg"])
    n, a = F.sum("n"), F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0))

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    acc = F.col("accepted")
    return t.groupBy("tau", "tau_s").agg(
        (a / n).alias("coverage"), ratio(total(acc & F.col("ok")), a).alias("acc"), total(acc & ~F.col("ok")).alias("wrong"),
        total(acc & F.col("fe")).alias("sens_fe"),
        ratio(total(acc & F.col("_sg") & F.col("hit")), total(F.col("_sg"))).alias("sens_recall"))


def worst_labels(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"), (1 - share(F.col("ok"))).alias("error")).orderBy(
        F.desc("error"), "label").limit(n)


def bench_summary(df: DataFrame, run: str, metrics: str) -> DataFrame:
    """Runs hold a map metric -> list of values: percentiles and mean per run and metric."""
    each = df.select(run, F.explode(metrics).alias("metric", "vals")).select(run, "metric", F.explode("vals").alias("v"))
    mean = each.groupBy(run, "metric").agg(F.avg("v").alias("mean"))
    return exact_percentiles(each, "v", {"p50": 0.5, "p95": 0.95}, [run, "metric"]).drop("max").join(mean, [run, "metric"])


def config_table(df: DataFrame, row: str, col: str, cols: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(col, cols).agg(F.first(value))
