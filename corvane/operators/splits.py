"""Splits, folds and samples. Every random choice is a hash of the row's own id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, in_train_half
from ..functions.ranking import hash_ordinal, ordinal


def hash_half_split(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("half", F.when(in_train_half(key), "train").otherwise("test"))


def per_label_split(df: DataFrame, label: str, row_id: str, parts: dict[str, float], seed: str) -> DataFrame:
    """Exact shares inside each label: cut points are round-half-even of the running share
    times the label's rows; the last part takes the rest."""
    ranked = hash_ordinal(df, [label], hash_int(seed, F.col(row_id)), [row_id], "_rn", "_size")
    names = list(parts)
    cum, part = 0.0, None
    for name in names[:-1]:
        cum += parts[name]
        hit = F.col("_rn") <= F.bround(F.lit(cum) * F.col("_size"), 0)
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return ranked.withColumn("part", part.otherwise(names[-1])).drop("_rn", "_size")


def leave_one_group_out(df: DataFrame, group: str, groups: list) -> DataFrame:
    """Each row once per group as fold, with its role in that fold. `groups` are the fold
    names, a parameter as they are few."""
    folds = F.array(*[F.lit(g) for g in groups])
    return df.withColumn("fold", F.explode(folds)).withColumn(
        "role", F.when(F.col(group) == F.col("fold"), "test").otherwise("train")
    )


def stratified_kfold(df: DataFrame, label: str, row_id: str, k: int, seed: str) -> DataFrame:
    ranked = hash_ordinal(df, [label], hash_int(seed, F.col(row_id)), [row_id], "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("bigint")).drop("_rn")


def kfold(df: DataFrame, row_id: str, k: int, seed: str) -> DataFrame:
    """A seeded permutation cut into k runs whose lengths differ by one at most, the longer first."""
    ranked = hash_ordinal(df, [], hash_int(seed, F.col(row_id)), [row_id], "_rn", "_size")
    pos, size = F.col("_rn") - 1, F.col("_size")
    small, extra = F.floor(size / k), size % k
    border = extra * (small + 1)
    fold = F.when(pos < border, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - border) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("fold", fold.cast("bigint")).drop("_rn", "_size")


def group_kfold(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """All rows of a group in one fold. The fold is decided on the distinct groups."""
    groups = df.select(group).distinct()
    ranked = hash_ordinal(groups, [], hash_int(seed, F.col(group)), [group], "_rn")
    folds = ranked.select(group, ((F.col("_rn") - 1) % k).cast("bigint").alias("fold"))
    return df.join(folds, group)


def learning_curve_subsets(df: DataFrame, row_id: str, fracs: list[float], seed: str) -> DataFrame:
    """Nested prefixes of one permutation: a row appears under every fraction it falls in."""
    ranked = hash_ordinal(df, [], hash_int(seed, F.col(row_id)), [row_id], "_rn", "_size")
    inside = F.filter(
        F.array(*[F.lit(f) for f in fracs]), lambda f: F.col("_rn") <= F.bround(f * F.col("_size"), 0)
    )
    return ranked.withColumn("frac", F.explode(inside)).drop("_rn", "_size")


def upweight(df: DataFrame, when: Column, n: int) -> DataFrame:
    """Rows that meet the condition n times, the others once."""
    times = F.when(when, n).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def stride_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every k-th row, starting at the first."""
    return ordinal(df, [], order, out="_rn").filter((F.col("_rn") - 1) % k == 0).drop("_rn")


def groups_with_min(df: DataFrame, group: str, n: int) -> DataFrame:
    big = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(group)
    return df.join(big, group, "left_semi")


def cross_source_split(df: DataFrame, source: str, a, b) -> DataFrame:
    """Rows of two sources in both directions: trained on one and tested on the other."""
    ways = F.array(
        F.struct(F.lit(f"{a}->{b}").alias("direction"), F.lit(a).alias("train_on")),
        F.struct(F.lit(f"{b}->{a}").alias("direction"), F.lit(b).alias("train_on")),
    )
    return (
        df.filter(F.col(source).isin(a, b)).withColumn("_w", F.explode(ways))
        .withColumn("direction", F.col("_w.direction"))
        .withColumn("role", F.when(F.col(source) == F.col("_w.train_on"), "train").otherwise("test"))
        .drop("_w")
    )
