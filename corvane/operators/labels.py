"""Merging annotators' answers."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import exact_dedup


def latest_label(log: DataFrame, row_id: str, order: list[str], value: str) -> DataFrame:
    """The last written answer of each id."""
    return log.groupBy(row_id).agg(F.max_by(value, F.struct(*order)).alias(value))


def agree_filter(cand: DataFrame, judged: DataFrame, row_id: str, correct: Column) -> DataFrame:
    """Adds `status`: unjudged, agree or disagree. `correct` compares `gold` with `judge_label`."""
    joined = cand.join(judged, row_id, "left")
    return joined.withColumn(
        "status",
        F.when(F.col("judge_label").isNull(), "unjudged").when(correct, "agree").otherwise("disagree"),
    )


def agree_split(joined: DataFrame, group: str) -> DataFrame:
    """Per group: agreed, ambiguous, and ambiguous rows whose second choice matches."""
    amb = F.col("status") == "disagree"
    return joined.groupBy(group).agg(
        F.count_if(F.col("status") == "agree").alias("agreed"),
        F.count_if(amb).alias("ambiguous"),
        F.count_if(amb & F.coalesce(F.col("second") == F.col("gold"), F.lit(False))).alias("second_matches"),
    )


def top_disagreements(joined: DataFrame, n: int) -> DataFrame:
    return (
        joined.filter("status = 'disagree'").groupBy("gold", "judge_label").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "gold", "judge_label").limit(n)
    )


def agreement_report(joined: DataFrame, group: list[str], label: str, top: int = 15) -> DataFrame:
    """What an agreement step reports, as (what, key, n): rows per status, agreed and disagreeing rows per column of
    `group`, agreed rows per combination of them, agreed rows of the rarest and the commonest label, and the `top`
    disagreements. Null keys are shown as `?`. Everything comes from one count per combination."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in group]
    per = joined.groupBy("status", *keys, F.col(label).alias("_gold"), "judge_label").agg(F.count("*").alias("n"))
    agree, dis = per.filter("status = 'agree'"), per.filter("status = 'disagree'")

    def counted(df, what, key):
        return df.groupBy(F.lit(what).alias("what"), key.alias("key")).agg(F.sum("n").alias("n"))

    parts = [counted(per, "status", F.col("status")), counted(agree, "agree", F.concat_ws("/", *group))]
    for c in group:
        parts += [counted(agree, f"agree_{c}", F.col(c)), counted(dis, f"disagree_{c}", F.col(c))]
    labels = agree.groupBy("_gold").agg(F.sum("n").alias("n"))
    parts += [labels.agg(f("n").alias("n")).select(F.lit("label").alias("what"), F.lit(name).alias("key"), "n").filter("n IS NOT NULL")
              for f, name in ((F.min, "min"), (F.max, "max"))]
    worst = dis.groupBy("_gold", "judge_label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_gold", "judge_label").limit(top)
    parts.append(worst.select(F.lit("disagreement").alias("what"), F.concat_ws("->", "_gold", "judge_label").alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def multilabel_gold(df: DataFrame, generated: str, judged: str, out: str = "gold") -> DataFrame:
    """The generator's labels the judge confirmed, in the generator's order; rows left
    without any fall away."""
    return df.withColumn(out, F.array_intersect(generated, judged)).filter(F.size(out) > 0)


def merge_judges(logs: list[DataFrame], row_id: str, value: str) -> DataFrame:
    """One answer per id; a later log in the list overrides an earlier one, and inside a log
    the last position wins."""
    tagged = [
        log.select(row_id, "pos", "judge", value, F.lit(i).alias("prio")) for i, log in enumerate(logs)
    ]
    merged = reduce(DataFrame.unionByName, tagged)
    top = F.max_by(F.struct("judge", value), F.struct("prio", "pos"))
    return merged.groupBy(row_id).agg(top.alias("m")).select(row_id, "m.*")


def same_family_violations(df: DataFrame, family: str, judge: str) -> DataFrame:
    """Rows judged by the family that wrote them; must be empty."""
    return df.filter(F.col(family) == F.col(judge))


def merge_judges_of(items: DataFrame, logs: list[DataFrame], row_id: str, value: str, family: str) -> DataFrame:
    """The items with the merged answer (`judge` and `value`, null where none answered). A row whose final judge is of the
    family that wrote it stops the job: an answer of one's own family is no evidence. An overridden one is no fault."""
    met = items.join(merge_judges(logs, row_id, value), row_id, "left")
    fault = F.concat(F.lit("judged by its own family: "), F.col(row_id).cast("string"))
    return met.withColumn("judge", F.when(F.col(family) == F.col("judge"), F.raise_error(fault)).otherwise(F.col("judge")))


def keep_first_partial(log: DataFrame, row_id: str, order: list[str]) -> DataFrame:
    return exact_dedup(log, [row_id], order)


def batch_completeness(items: DataFrame, answers: DataFrame, batch: str, min_frac: float) -> DataFrame:
    """Batches with the share answered, and whether that share is enough."""
    asked = items.groupBy(batch).agg(F.count("*").alias("asked"))
    got = answers.groupBy(batch).agg(F.count("*").alias("answered"))
    return asked.join(got, batch, "left").select(
        batch, "asked", F.coalesce("answered", F.lit(0)).alias("answered"),
        (F.coalesce("answered", F.lit(0)) >= F.col("asked") * min_frac).alias("complete"),
    )


def annotate_batches(df: DataFrame, annotators: list, n: int, retries: int = 2) -> DataFrame:
    """Sends batches of n (id, text) rows to the first annotator that answers.

    An annotator is a callable list[str] -> list[str]. A batch that no annotator answers in
    full comes back with null labels, to be asked again by a later run.
    """

    def ask(texts):
        for who, call in enumerate(annotators):
            for _ in range(retries):
                try:
                    labels = call(texts)
                except Exception:  # noqa: BLE001 - an outside service may fail in any way
                    continue
                if len(labels) == len(texts):
                    return labels, who
        return [None] * len(texts), None

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), n):
                part = pdf.iloc[i:i + n]
                labels, who = ask(list(part["text"]))
                yield pd.DataFrame({"id": part["id"], "label": labels,
                                    "annotator": pd.array([who] * len(part), dtype="Int32")})

    return df.select("id", "text").mapInPandas(run, "id bigint, label string, annotator int")


def spot_check(df: DataFrame, row_id: str, n: int, seed: str) -> DataFrame:
    order = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(seed)))
    return df.orderBy(order, row_id).limit(n)


def agreement_by(df: DataFrame, dims: list[str], agreed: Column) -> DataFrame:
    """Judged and agreed rows for every combination of the dimensions ('*' = all)."""
    return (
        df.cube(*dims).agg(F.count("*").alias("judged"), F.count_if(agreed).alias("agreed"))
        .select(*[F.coalesce(F.col(d), F.lit("*")).alias(d) for d in dims], "judged", "agreed")
    )
