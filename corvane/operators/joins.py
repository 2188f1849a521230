"""Joins between item tables, reference sets and runs."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_refs(refs, key: str) -> DataFrame:
    """key -> tag of the last listed reference set that holds it. refs: (tag, rows) pairs, the later
    overriding the earlier, or one table (key, prio, tag) read in one pass."""
    if isinstance(refs, DataFrame):
        tagged = refs.select(key, F.struct("prio", "tag").alias("t"))
    else:
        tagged = reduce(DataFrame.unionByName, [
            df.select(key, F.struct(F.lit(i).alias("prio"), F.lit(tag).alias("tag")).alias("t"))
            for i, (tag, df) in enumerate(refs)])
    return tagged.groupBy(key).agg(F.max("t")["tag"].alias("ref_tag"))


def anti_join_attributed(df: DataFrame, refs, key: str) -> DataFrame:
    """Adds `ref_tag`: null for rows to keep, else the reference set to blame."""
    return df.join(union_refs(refs, key), key, "left")


def resume_anti_join(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key)


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def attach_vectors(df: DataFrame, vecs: DataFrame, key: str, on_missing: str = "drop") -> DataFrame:
    """Inner join, or a run-time error at the first row that has no vector."""
    if on_missing == "drop":
        return df.join(vecs, key)
    joined = df.join(vecs.withColumn("_has", F.lit(True)), key, "left")
    complain = F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string")))
    return joined.withColumn("vec", F.when(F.col("_has"), F.col("vec")).otherwise(complain)).drop("_has")


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key column: how many rows of `a` share that key with `b`."""
    counts = [
        a.join(b.select(k), k, "left_semi").agg(F.count("*").alias("violations"))
        .select(F.lit(k).alias("key"), "violations")
        for k in keys
    ]
    return reduce(DataFrame.unionByName, counts)


def run_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str], conf: str) -> DataFrame:
    """Per field: rows compared, rows that differ, and the greatest confidence difference."""
    other = b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.col(conf).alias("_b_conf"))
    joined = a.join(other, key)
    counts = joined.agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col(conf) - F.col("_b_conf"))).alias("max_conf_diff"),
        *[F.count_if(~F.col(f).eqNullSafe(F.col(f"_b_{f}"))).alias(f"d_{f}") for f in fields],
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("differing")) for f in fields])
    return counts.select("n", "max_conf_diff", F.explode(pairs).alias("p")).select("p.*", "n", "max_conf_diff")


def run_flips(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """The rows whose label differs between two runs."""
    return (
        a.select(key, F.col(label).alias("a_label"))
        .join(b.select(key, F.col(label).alias("b_label")), key)
        .filter(~F.col("a_label").eqNullSafe(F.col("b_label")))
    )


def perturbed_vs_base(perturbed: DataFrame, base: DataFrame, correct: Column, kind: str) -> DataFrame:
    """Perturbed rows (id = base id, '-', suffix) against their base rows: accuracy and
    the share whose label did not move, per kind."""
    base_id = F.regexp_replace("id", "-[^-]*$", "")
    joined = perturbed.withColumn("base_id", base_id).join(
        base.select(F.col("id").alias("base_id"), F.col("pred").alias("base_pred")), "base_id"
    )
    return joined.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.avg(correct.cast("double")).alias("acc"),
        F.avg((F.col("pred") == F.col("base_pred")).cast("double")).alias("unchanged"),
    )


def label_scope_join(df: DataFrame, labels: list[str], tools: DataFrame, key: str) -> DataFrame:
    """The union of the tools of a row's predicted labels; rows without any get an empty list."""
    each = df.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*labels)))).alias("label"))
    scoped = each.join(tools, "label").groupBy(key).agg(F.array_sort(F.collect_set("tool")).alias("scope"))
    return df.select(key).join(scoped, key, "left").withColumn(
        "scope", F.coalesce("scope", F.array().cast("array<string>"))
    )
