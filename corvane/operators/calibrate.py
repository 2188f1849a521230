"""Temperatures, confidence thresholds and bands chosen under constraints.

A sweep tries every grid point on every row. The rows meet the grid only through the number
of thresholds they reach, so they are first counted by that number: a partial aggregate whose
result is bounded by the grid, whatever the table. The grid is then tried on the counts.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.once import let
from ..functions.ranking import cumulate
from ..functions.rules import count_if, grid_column, needed_conf, ratio, share


def reached(value: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds the value is at or above."""
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    return let(value, lambda v: F.size(F.filter(cuts, lambda t: v >= t)))


def grid_points(**axes) -> list[dict]:
    points = [{}]
    for name, vals in axes.items():
        points = [{**p, name: float(v)} for p in points for v in vals]
    return points


def threshold_counts(df: DataFrame, grid: list[dict], by=(), extra=()) -> DataFrame:
    """Counts by (grid point, accepted, ok, sens, fe, hit): at a point a row needs max(tau,
    tau_s) if the predicted label is sensitive, else tau."""
    cuts = sorted({p["tau"] for p in grid} | {max(p["tau"], p["tau_s"]) for p in grid})
    level = reached(F.col("conf"), cuts)
    hit = F.col("pred") == F.col("label")
    counts = df.groupBy(*by, *extra, level.alias("level"), "ok", "sens", (F.col("sens") & ~hit).alias("fe"), hit.alias("hit")).agg(
        F.count("*").alias("n"))
    points = [{**p, "need": cuts.index(p["tau"]) + 1, "need_s": cuts.index(max(p["tau"], p["tau_s"])) + 1} for p in grid]
    g = counts.withColumn("g", F.explode(grid_column(points)))
    need = F.when(F.col("sens"), F.col("g.need_s")).otherwise(F.col("g.need"))
    return g.select(*by, *extra, F.col("g.tau").alias("tau"), F.col("g.tau_s").alias("tau_s"), (F.col("level") >= need).alias("accepted"),
                    "ok", "sens", "fe", "hit", "n")


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0))


def threshold_sweep(df: DataFrame, grid: list[dict], by=(), empty_prec: float = 1.0) -> DataFrame:
    a = F.col("accepted")
    return threshold_counts(df, grid, by).groupBy(*by, "tau", "tau_s").agg(
        F.sum("n").alias("n"), _n(a).alias("accepted"), (_n(a) / F.sum("n")).alias("cov"),
        ratio(_n(a & F.col("ok")), _n(a)).alias("sel"), _n(a & F.col("fe")).alias("fe"),
        ratio(_n(a & F.col("sens") & F.col("ok")), _n(a & F.col("sens")), empty_prec).alias("sens_prec"))


def select_best(df: DataFrame, constraints: Column, order: list[Column], by=()) -> DataFrame:
    """The first eligible row in the given order; no row when none is eligible."""
    ok = df.filter(constraints)
    if not by:
        return ok.orderBy(*order).limit(1)
    w = W.partitionBy(*by).orderBy(*order)
    return ok.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


# The thresholds over which the acceptance rule is defined.
LOCKED_TAU = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99)
LOCKED_TAU_S = (0.95, 0.97, 0.98, 0.99)


def locked_rule(df: DataFrame, sel: float = 0.976, prec: float = 0.997, by=(), taus=LOCKED_TAU, taus_s=LOCKED_TAU_S) -> DataFrame:
    sweep = threshold_sweep(df, grid_points(tau=taus, tau_s=taus_s), by)
    return select_best(sweep, (F.col("sel") >= sel) & (F.col("sens_prec") >= prec), [F.desc("cov"), F.asc("tau_s"), F.asc("tau")], by)


def smallest_tau(df: DataFrame, taus: list[float], target: float, min_n: int = 5, default: float = 0.99, by=()) -> DataFrame:
    """The least threshold with enough accepted rows and accuracy among them."""
    sweep = threshold_sweep(df, [{"tau": t, "tau_s": 0.0} for t in taus], by)
    good = (F.col("accepted") >= min_n) & (F.col("sel") >= target)
    return sweep.groupBy(*by).agg(F.coalesce(F.min(F.when(good, F.col("tau"))), F.lit(default)).alias("tau"))


def sensitive_tau(df: DataFrame, start: float, target: float = 0.97, step: float = 0.01, cap: float = 0.99, floor: float = 0.95) -> DataFrame:
    """From max(start, floor), raised by steps until the sensitive precision is reached."""
    first = max(start, floor)
    k = int(round((cap - first) / step)) + 1
    taus = [min(cap, round(first + i * step, 6)) for i in range(k)]
    sweep = threshold_sweep(df, [{"tau": t, "tau_s": t} for t in taus])
    return sweep.agg(F.coalesce(F.min(F.when(F.col("sens_prec") >= target, F.col("tau_s"))), F.lit(cap)).alias("tau_s"))


def per_label_tau(df: DataFrame, base_tau: float, base_tau_s: float, taus=LOCKED_TAU, min_label=50, min_accepted=20,
                  target=0.976, target_s=0.997, default=0.99) -> DataFrame:
    """A threshold for each predicted label; labels with few predictions keep the base one."""
    cuts = sorted(taus)
    level = reached(F.col("conf"), cuts)
    counts = df.groupBy("pred", "sens", level.alias("level"), "ok").agg(F.count("*").alias("n"))
    g = counts.withColumn("g", F.explode(grid_column([{"tau": t, "need": i + 1} for i, t in enumerate(cuts)])))
    a = F.col("level") >= F.col("g.need")
    per = g.groupBy("pred", "sens", F.col("g.tau").alias("tau")).agg(
        F.sum("n").alias("n"), _n(a).alias("acc_n"), _n(a & F.col("ok")).alias("acc_ok"))
    goal = F.when(F.col("sens"), target_s).otherwise(target)
    good = (F.col("acc_n") >= min_accepted) & (F.col("acc_ok") / F.col("acc_n") >= goal)
    picked = per.groupBy("pred", "sens").agg(
        F.first("n").alias("n"), F.coalesce(F.min(F.when(good, F.col("tau"))), F.lit(default)).alias("pick"))
    base = F.when(F.col("sens"), max(base_tau, base_tau_s)).otherwise(base_tau)
    own = F.when(F.col("sens"), F.greatest(F.lit(base_tau_s), F.col("pick"))).otherwise(F.col("pick"))
    return picked.select("pred", "n", F.when(F.col("n") < min_label, base).otherwise(own).alias("tau"))


def _losses(steps: int):
    """Sums of the loss at every temperature of the grid, a row per batch."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z, top, own = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            size = np.diff(z.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            shift = z.flatten().to_numpy() - np.repeat(top, size)
            lo, hi = (b.column(i)[0].as_py() for i in (3, 4))
            t = [lo + (hi - lo) / steps * i for i in range(steps + 1)]
            loss = [float(-np.log(np.exp((own - top) / v) / np.add.reduceat(np.exp(shift / v), start) + 1e-12).sum()) for v in t]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([lo]), pa.array([hi]), pa.array([loss], pa.list_(pa.float64()))],
                                             names=["n", "lo", "hi", "loss"])

    return run


def temperature_pass(df: DataFrame, z: str, y: Column, lo: Column, hi: Column, steps: int, t_min: float, t_max: float) -> DataFrame:
    """One row (t, lo, hi): the best temperature of an even grid and the range around it. Rows never meet the grid: a
    task sums the losses of all grid points per batch. Rows with a null label or logit count for nothing."""
    v = F.col(z).cast("array<double>")
    whole = y.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    rows = df.filter(whole).select(v.alias("z"), F.array_max(v).alias("top"), F.element_at(v, y + 1).alias("own"), lo.alias("lo"), hi.alias("hi"))
    sums = rows.mapInArrow(_losses(steps), "n long, lo double, hi double, loss array<double>")
    mean = F.array(*[F.sum(F.get("loss", F.lit(i))) / F.sum("n") for i in range(steps + 1)])
    per = sums.agg(F.first("lo").alias("lo"), ((F.first("hi") - F.first("lo")) / steps).alias("w"), mean.alias("mean"))
    best = F.array_min(F.transform("mean", lambda m, i: F.struct(F.round(m, 12).alias("r"), i.alias("i"), m.alias("nll"))))
    t = F.col("lo") + F.col("w") * F.col("b.i")
    return per.withColumn("b", best).select(
        t.alias("t"), F.col("b.nll").alias("nll"), F.greatest(F.lit(t_min), t - F.col("w")).alias("lo"), F.least(F.lit(t_max), t + F.col("w")).alias("hi"))


def fit_temperature(df: DataFrame, z: str, y: Column, t_min=0.05, t_max=20.0, steps=20, passes=4) -> DataFrame:
    """The temperature with the least mean negative log likelihood, by repeated grids, each
    around the best point of the one before."""
    out = temperature_pass(df, z, y, F.lit(t_min), F.lit(t_max), steps, t_min, t_max)
    for _ in range(passes - 1):
        around = out.select(F.struct("lo", "hi")).scalar()
        out = temperature_pass(df, z, y, around["lo"], around["hi"], steps, t_min, t_max)
    return out.select("t", "nll")


def two_temperature(df: DataFrame, z: str, y: Column, sensitive: Column, **kw) -> DataFrame:
    """One temperature for rows whose largest logit is a sensitive label, one for the rest."""
    parts = [fit_temperature(df.filter(c), z, y, **kw).withColumn("sens", F.lit(s))
             for c, s in ((sensitive, True), (~sensitive, False))]
    return reduce(DataFrame.unionByName, parts)


def element_at_rank(df: DataFrame, value: str, rank) -> DataFrame:
    """The value whose 0-based sorted position is rank(n), n being the rows; found from
    counts per distinct value."""
    per = df.groupBy(value).agg(F.count("*").alias("n"))
    c = cumulate(per, [], value, ["n"])
    k = rank(F.col("n_all"))
    return c.filter((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))).select(F.col(value).alias("value"), F.col("n_all"))


def quantile_bands(df: DataFrame, score: str, positive: Column, few: int = 20) -> DataFrame:
    """hi: at most 5 % of the negatives reach it; lo: at most 5 % of the positives are below
    it, and never above hi. With few negatives hi lies above all of them."""
    neg, pos = df.filter(~positive), df.filter(positive)
    hi = element_at_rank(neg, score, lambda n: F.least(n - 1, F.ceil(F.lit(0.95) * n)))
    top = neg.agg(F.max(score)).scalar()
    hi = hi.select(F.when(F.col("n_all") < few, F.greatest("value", top + 1e-9)).otherwise(F.col("value")).alias("hi"))
    lo = element_at_rank(pos, score, lambda n: F.floor(F.lit(0.05) * n)).select(F.col("value").alias("lo"))
    return hi.withColumn("_lo", lo.scalar()).select("hi", F.least("_lo", "hi").alias("lo"))


def grant(top: Column, gap: Column, lookup: Column, excluded: Column, t=0.78, g=0.10, tl=0.70, gl=0.05) -> Column:
    def c(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    return (((top >= c(t)) & (gap >= c(g))) | (lookup & (top >= c(tl)) & (gap >= c(gl)))) & ~excluded


def calibrate_grant(df: DataFrame, ts: list[float], gs: list[float], target: float, min_n: int, part: str) -> DataFrame:
    """The (t, g) of most grants whose accuracy meets the target on the pool and in every
    part that has grants. Rows (top, gap, lookup, excluded, ok, part) are counted by the
    thresholds they reach before the grid is tried."""
    points = [{"t": t, "g": g, "tl": t - 0.8 * g, "gl": g / 2} for t in ts for g in gs]
    tc = sorted({p["t"] for p in points} | {p["tl"] for p in points})
    gc = sorted({p["g"] for p in points} | {p["gl"] for p in points})
    counts = df.groupBy(reached(F.col("top"), tc).alias("tv"), reached(F.col("gap"), gc).alias("gv"),
                        "lookup", "excluded", "ok", part).agg(F.count("*").alias("n"))
    grid = [{"t": p["t"], "g": p["g"], "it": tc.index(p["t"]) + 1, "itl": tc.index(p["tl"]) + 1,
             "ig": gc.index(p["g"]) + 1, "igl": gc.index(p["gl"]) + 1} for p in points]
    x = counts.withColumn("p", F.explode(grid_column(grid)))
    granted = (((F.col("tv") >= F.col("p.it")) & (F.col("gv") >= F.col("p.ig")))
               | (F.col("lookup") & (F.col("tv") >= F.col("p.itl")) & (F.col("gv") >= F.col("p.igl")))) & ~F.col("excluded")
    per = x.groupBy(F.col("p.t").alias("t"), F.col("p.g").alias("g"), part).agg(
        F.sum("n").alias("n"), _n(granted).alias("a"), _n(granted & F.col("ok")).alias("c"))
    pool = per.groupBy("t", "g").agg(
        (F.sum("a") / F.sum("n")).alias("cov"), ratio(F.sum("c"), F.sum("a")).alias("sel"), F.sum("a").alias("granted"),
        F.min(F.when(F.col("a") > 0, F.col("c") / F.col("a")).otherwise(1.0)).alias("worst_part"))
    good = (F.col("granted") >= min_n) & (F.col("sel") >= target) & (F.col("worst_part") >= target)
    return select_best(pool, good, [F.desc("cov"), F.asc("t"), F.asc("g")])


def eligibility_gates(df: DataFrame, limits: dict[str, int], cov: str, primary: str, members: str) -> DataFrame:
    """Candidates within every false-exposure limit are eligible; `score` is coverage + primary
    accuracy, and the eligible candidate of the greatest score is `chosen`, on ties the one with fewer
    members (names joined by commas), then the first by name. Scores equal to twelve digits tie."""
    ok = reduce(lambda a, b: a & b, [F.col(c) <= v for c, v in limits.items()])
    scored = df.withColumn("eligible", ok).withColumn("score", F.col(cov) + F.col(primary))
    order = [F.round("score", 12).desc(), F.size(F.split(members, ",")).asc(), F.col(members).asc()]
    best = select_best(scored, F.col("eligible"), order).select(F.col(members).alias("_best"))
    return scored.join(F.broadcast(best), F.col(members) == F.col("_best"), "left").withColumn(
        "chosen", F.col("_best").isNotNull()).drop("_best")


def closest_miss(sweep: DataFrame, by: list[str], sel: float = 0.976, prec: float = 0.997) -> DataFrame:
    """Where no point meets the rule: the point of greatest accuracy, the most accurate with
    enough sensitive precision, and the one of most sensitive precision with enough accuracy."""
    point = F.struct("tau", "tau_s", "sel", "sens_prec")

    def best(cond, first):
        return F.max_by(F.when(cond, point), F.when(cond, F.struct(first, (-F.col("tau_s")).alias("x"), (-F.col("tau")).alias("y"))))

    return sweep.groupBy(*by).agg(
        best(F.lit(True), "sel").alias("max_sel"), best(F.col("sens_prec") >= prec, "sel").alias("best_prec_ok"),
        best(F.col("sel") >= sel, "sens_prec").alias("best_sel_ok"))
