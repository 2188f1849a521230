"""Exact positions inside a group, with no task that holds the whole group.

`row_number() over (partition by g order by x)` puts one group in one task. When a label
or a source holds a third of all rows that task decides the run time. Here the order
column is cut into cells, the cells are counted (a partial aggregate), and a row's position is
the count of all earlier cells plus its place inside its own cell. Cells end at approximate
quantiles of the column, so an outlier takes nothing from the others, and their number follows
the number of rows. The result is exact whatever the cell borders are; they only spread the work.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import HASH_SPAN

CELL_ROWS = 1_000_000  # rows aimed at in a cell
LEAST, MOST = 16, 1024


def _cells(n: int) -> int:
    return min(MOST, max(LEAST, math.ceil(n / CELL_ROWS)))


def _between(x: Column, borders: list, lo: int, hi: int) -> Column:
    """The number of borders that are not over x, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < F.lit(borders[mid]), _between(x, borders, lo, mid)).otherwise(_between(x, borders, mid + 1, hi))


def with_cell(df: DataFrame, order: str, span=None) -> DataFrame:
    """Adds `_cell`, non-decreasing in `order`. span = (lo, hi) when the column is known to be spread
    evenly over that range, as a hash is; else borders come from one pass over the column."""
    x = F.col(order)
    if span is not None:
        lo, hi = span
        cells = _cells(df.count())
        return df.withColumn("_cell", F.least(F.floor((x - lo) / F.lit((hi - lo) / cells)), F.lit(cells - 1)).cast("int"))
    steps = [i / LEAST for i in range(1, LEAST)]
    ends = df.agg(F.count(x).alias("n"), F.percentile_approx(x, steps, 10_000).alias("q")).first()
    cells = _cells(ends["n"])
    if cells > LEAST:
        steps = [i / cells for i in range(1, cells)]
        ends = df.agg(F.percentile_approx(x, steps, 20 * cells).alias("q")).first()
    borders = sorted(set(ends["q"] or []))
    return df.withColumn("_cell", _between(x, borders, 0, len(borders)))


def _before(by: list[str]):
    return W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)


def ordinal(df: DataFrame, by=(), order="id", ties=(), out="rn", size=None, span=None):
    """Adds `out`, the 1-based position in the group by (order, ties); `size` names the
    column for the group's row count. `order` is numeric and not null."""
    by = list(by)
    celled = with_cell(df, order, span)
    counts = celled.groupBy(*by, "_cell").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        *by, "_cell",
        F.coalesce(F.sum("__n").over(_before(by)), F.lit(0)).alias("__start"),
        F.sum("__n").over(W.partitionBy(*by)).alias("__size"),
    )
    inside = W.partitionBy(*by, "_cell").orderBy(order, *ties)
    ranked = celled.withColumn("__rn", F.row_number().over(inside))
    joined = _join_null_safe(ranked, offsets, by + ["_cell"])
    joined = joined.withColumn(out, (F.col("__start") + F.col("__rn")).cast("bigint"))
    if size:
        joined = joined.withColumn(size, F.col("__size"))
    return joined.drop("_cell", "__rn", "__start", "__size")


def hash_ordinal(df: DataFrame, by, hash_col: Column, ties, out="rn", size=None):
    """Position in the order of a 32-bit hash, the form of a seeded shuffle."""
    keyed = df.withColumn("_h", hash_col)
    return ordinal(keyed, by, "_h", ties, out, size, span=(0, HASH_SPAN)).drop("_h")


def cumulate(df: DataFrame, by, value: str, sums: list[str]) -> DataFrame:
    """For rows unique in (by, value): adds `<s>_before`, the sum over smaller values, and
    `<s>_all`, the group's sum, for each named column."""
    by = list(by)
    celled = with_cell(df, value)
    per_cell = celled.groupBy(*by, "_cell").agg(*[F.sum(s).alias(f"_c_{s}") for s in sums])
    starts = per_cell.select(
        *by, "_cell",
        *[F.coalesce(F.sum(f"_c_{s}").over(_before(by)), F.lit(0)).alias(f"_s_{s}") for s in sums],
        *[F.sum(f"_c_{s}").over(W.partitionBy(*by)).alias(f"{s}_all") for s in sums],
    )
    inside = (
        W.partitionBy(*by, "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    local = celled
    for s in sums:
        local = local.withColumn(f"_l_{s}", F.coalesce(F.sum(s).over(inside), F.lit(0)))
    joined = _join_null_safe(local, starts, by + ["_cell"])
    for s in sums:
        joined = joined.withColumn(f"{s}_before", F.col(f"_s_{s}") + F.col(f"_l_{s}"))
    return joined.drop("_cell", *[f"_l_{s}" for s in sums], *[f"_s_{s}" for s in sums])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def exact_percentiles(df: DataFrame, value: str, ps: dict[str, float], by=()) -> DataFrame:
    """Percentiles with linear interpolation, `n` and `max`, per group. The built-in exact
    percentile gathers every distinct value of a group in one task; this finds the two
    neighbouring order statistics from running counts instead."""
    by = list(by)
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    c = cumulate(per, by, value, ["n"])

    def element(k: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))

    aggs = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("n_all") - 1)
        aggs += [element(F.floor(h)).alias(f"_lo_{name}"), element(F.ceil(h)).alias(f"_hi_{name}"),
                 F.first(h - F.floor(h)).alias(f"_f_{name}")]
    out = c.groupBy(*by).agg(F.first("n_all").alias("n"), F.max(value).alias("max"), *aggs)
    return out.select(*by, "n", "max", *[
        (F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * F.col(f"_f_{x}")).alias(x) for x in ps])
