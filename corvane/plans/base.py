"""Registry of the queries and the tables and derived views they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..functions.rules import LabelMeta, is_correct, is_sensitive
from ..functions.text import norm_key_plain

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that arrives in fewer pieces than there are cores, dealt out by key before costly
    work on its rows. A large table has more pieces than cores and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


# --- SQL twins of the helpers ------------------------------------------------------------

def sql_hint(expr: str) -> str:
    return f"(('0x'||substr(md5({expr}),1,8))::BIGINT)"


def sql_hunit(expr: str) -> str:
    return f"({sql_hint(expr)}/4294967296::DOUBLE)"


def sql_key(col: str) -> str:
    return f"regexp_replace(lower({col}),'[^\\p{{L}}\\p{{N}}_]+','','g')"


def sql_dot(u: str, v: str) -> str:
    return f"list_dot_product({u}::DOUBLE[],{v}::DOUBLE[])"


def sql_grid(name: str, cols: dict[str, list]) -> str:
    """CTEs for a parameter grid: every combination of the listed values."""
    parts = [f"(SELECT unnest([{','.join(repr(x) for x in v)}]) AS {k})" for k, v in cols.items()]
    return f"{name} AS (SELECT * FROM " + " CROSS JOIN ".join(parts) + ")"


# --- label sets of the derived predictions ---------------------------------------------------
# Embedding labels run 0-9. Label 0 plays the declined label, 1 may stand in for it,
# and 7, 8, 9 are sensitive.
META = LabelMeta(unknown=0, safe_unknown=(0, 1), sensitive=(7, 8, 9))
LABELS = list(range(10))
SQL_OK = "({p}={g} OR ({g}=0 AND {p} IN (0,1)))"
SQL_SENS = "({p} IN (7,8,9))"


def sql_ok(g="label", p="pred"):
    return SQL_OK.format(g=g, p=p)


def sql_sens(p="pred"):
    return SQL_SENS.format(p=p)


# --- derived views --------------------------------------------------------------------------

def items(spark, sf) -> DataFrame:
    """documents with their key."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("fam"),
                    norm_key_plain(F.col("text")).alias("key"))


ITEMS = f"items AS (SELECT doc_id AS id, text, lang, source AS fam, {sql_key('text')} AS key FROM documents)"


def keyed(df: DataFrame) -> DataFrame:
    """The key as its md5: what is shuffled and compared is short however long the text is."""
    return df.withColumn("key", F.md5("key"))


def candidates_and_refs(spark, sf):
    """Unlabelled documents are candidates; labelled ones are the sets a candidate must not
    repeat, 'good', 'low' (quality 0) and 'toxic', the later overriding the earlier, as one table."""
    it = keyed(items(spark, sf))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    cand = it.join(lab.select("id"), "id", "left_anti")
    prio = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    tag = F.element_at(F.array(F.lit("good"), F.lit("low"), F.lit("toxic")), F.col("prio") + 1)
    return cand, it.join(lab, "id").select("key", prio.alias("prio")).withColumn("tag", tag)


CAND = ITEMS + """, cand AS (SELECT * FROM items WHERE id NOT IN (SELECT doc_id FROM labels)),
refs0 AS (SELECT i.key, CASE WHEN toxic=1 THEN 2 WHEN quality=0 THEN 1 ELSE 0 END AS prio FROM items i JOIN labels l ON i.id=l.doc_id),
refs AS (SELECT key, ['good','low','toxic'][max(prio)+1] AS ref_tag FROM refs0 GROUP BY key)"""


def preds(spark, sf) -> DataFrame:
    """One prediction per embedding, with a signal: confidence is uniform on [.5, 1) and the
    prediction is right with that probability."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    e = e.select(
        "id", "label", (0.5 + 0.5 * hash_unit("c-", F.col("id"))).alias("conf"),
        hash_unit("p-", F.col("id")).alias("hp"), hash_unit("q-", F.col("id")).alias("hq"),
    )
    wrong = (F.col("label") + 1 + F.floor(9 * F.col("hq"))) % 10
    e = e.withColumn("pred", F.when(F.col("hp") < F.col("conf"), F.col("label")).otherwise(wrong).cast("int"))
    return (
        e.drop("hp", "hq")
        .withColumn("ok", is_correct(F.col("label"), F.col("pred"), META))
        .withColumn("sens", is_sensitive(F.col("pred"), META))
    )


PREDS = f"""preds AS (SELECT *, {sql_ok()} AS ok, {sql_sens()} AS sens FROM (
 SELECT id, label, conf, (CASE WHEN hp<conf THEN label ELSE (label+1+floor(9*hq)::INT)%10 END)::INT AS pred FROM (
  SELECT vec_id AS id, label, 0.5+0.5*{sql_hunit("'c-'||vec_id")} AS conf, {sql_hunit("'p-'||vec_id")} AS hp,
  {sql_hunit("'q-'||vec_id")} AS hq FROM embeddings)))"""


def runs(spark, sf) -> DataFrame:
    """Logged decisions per embedding: a first layer with its own label and score, the head's
    top label and probability, the deciding layer, the reason and times in ms."""
    p = preds(spark, sf)
    i = F.col("id")
    l2_right = hash_unit("l2r-", i) < 0.7
    r = p.select(
        "id", "label", F.col("pred").alias("head_label"), F.col("conf").alias("head_p"),
        F.when(l2_right, F.col("label")).otherwise((F.col("label") + 1 + F.floor(9 * hash_unit("l2w-", i))) % 10)
        .cast("int").alias("l2_label"),
        (0.4 + 0.6 * hash_unit("l2c-", i)).alias("l2_score"),
        (0.3 * hash_unit("l2g-", i)).alias("l2_gap"),
        (hash_unit("deg-", i) < 0.2).alias("degraded"),
        F.floor(10 * hash_unit("sec-", i)).cast("int").alias("secondary"),
        (5 + 95 * hash_unit("ms-", i)).alias("ms"),
    )
    l2_conf = (F.col("l2_score") >= 0.78) & (F.col("l2_gap") >= 0.10)
    need = F.when(F.col("head_label").isin(*META.sensitive), F.lit(0.95)).otherwise(F.lit(0.80))
    head_ok = F.col("head_p") >= need
    return (
        r.withColumn("l2_confident", l2_conf)
        .withColumn("layer", F.when(l2_conf, 2).when(head_ok, 3).otherwise(0).cast("int"))
        .withColumn("pred", F.when(l2_conf, F.col("l2_label")).when(head_ok, F.col("head_label"))
                    .otherwise(0).cast("int"))
        .withColumn("conf", F.when(l2_conf, F.col("l2_score")).otherwise(F.col("head_p")))
        .withColumn("reason", F.when(l2_conf, "l2_embedding:confident").when(head_ok, "head:accepted")
                    .when(F.col("degraded"), "head:timeout").otherwise("head:below_tau"))
    )


RUNS = PREDS + f""", runs0 AS (SELECT id, label, pred AS head_label, conf AS head_p,
 (CASE WHEN {sql_hunit("'l2r-'||id")}<0.7 THEN label ELSE (label+1+floor(9*{sql_hunit("'l2w-'||id")})::INT)%10 END)::INT AS l2_label,
 0.4::DOUBLE+0.6::DOUBLE*{sql_hunit("'l2c-'||id")} AS l2_score, 0.3::DOUBLE*{sql_hunit("'l2g-'||id")} AS l2_gap,
 {sql_hunit("'deg-'||id")}<0.2 AS degraded, floor(10*{sql_hunit("'sec-'||id")})::INT AS secondary,
 5+95*{sql_hunit("'ms-'||id")} AS ms FROM preds),
runs1 AS (SELECT *, l2_score>=0.78 AND l2_gap>=0.10 AS l2_confident,
 head_p >= CASE WHEN head_label IN (7,8,9) THEN 0.95 ELSE 0.80 END AS head_ok FROM runs0),
runs AS (SELECT * EXCLUDE(head_ok), (CASE WHEN l2_confident THEN 2 WHEN head_ok THEN 3 ELSE 0 END)::INT AS layer,
 (CASE WHEN l2_confident THEN l2_label WHEN head_ok THEN head_label ELSE 0 END)::INT AS pred,
 CASE WHEN l2_confident THEN l2_score ELSE head_p END AS conf,
 CASE WHEN l2_confident THEN 'l2_embedding:confident' WHEN head_ok THEN 'head:accepted'
  WHEN degraded THEN 'head:timeout' ELSE 'head:below_tau' END AS reason FROM runs1)"""


def second_run(spark, sf) -> DataFrame:
    """The same inputs decided by another system: its own confidence, right less often."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    i = F.col("id")
    conf = 0.5 + 0.5 * hash_unit("c2-", i)
    wrong = (F.col("label") + 1 + F.floor(9 * hash_unit("q2-", i))) % 10
    pred = F.when(hash_unit("p2-", i) < conf - 0.1, F.col("label")).otherwise(wrong).cast("int")
    return e.select("id", "label", conf.alias("conf"), pred.alias("pred")).withColumn(
        "ok", is_correct(F.col("label"), F.col("pred"), META)
    ).withColumn("sens", is_sensitive(F.col("pred"), META))


RUN2 = f"""run2 AS (SELECT *, {sql_ok()} AS ok, {sql_sens()} AS sens FROM (SELECT id, label, conf,
 (CASE WHEN hp<conf-0.1::DOUBLE THEN label ELSE (label+1+floor(9*hq)::INT)%10 END)::INT AS pred FROM (
 SELECT vec_id AS id, label, 0.5+0.5*{sql_hunit("'c2-'||vec_id")} AS conf, {sql_hunit("'p2-'||vec_id")} AS hp,
 {sql_hunit("'q2-'||vec_id")} AS hq FROM embeddings)))"""


def judge_log(spark, sf, judge: str) -> DataFrame:
    """Answers of one annotator on the labelled documents, as a log with repeats: every
    document is answered at position 0, a hashed third of them again at position 1."""
    lab = table(spark, sf, "labels")
    value = F.col("quality") if judge == "alpha" else (1 - F.col("toxic"))
    again = F.when(hash_unit(f"{judge}-again-", F.col("doc_id")) < 1 / 3, 2).otherwise(1)
    flip = hash_unit(f"{judge}-flip-", F.col("doc_id"), "-", F.col("pos")) < 0.1
    return (
        lab.select(F.col("doc_id").alias("id"), value.alias("v"), F.col("doc_id"),
                   F.explode(F.sequence(F.lit(0), again - 1)).alias("pos"))
        .select("id", F.col("pos").cast("bigint").alias("pos"), F.lit(judge).alias("judge"),
                F.when(flip, 1 - F.col("v")).otherwise(F.col("v")).cast("int").alias("judge_label"))
    )


def sql_judge(name: str) -> str:
    v = "quality" if name == "alpha" else "1-toxic"
    again = sql_hunit(f"'{name}-again-'||doc_id")
    flip = sql_hunit(f"'{name}-flip-'||doc_id||'-'||pos")
    return f"""judge_{name} AS (SELECT doc_id AS id, pos::BIGINT AS pos, '{name}' AS judge,
 (CASE WHEN {flip}<0.1 THEN 1-v ELSE v END)::INT AS judge_label FROM (
 SELECT doc_id, {v} AS v, unnest(CASE WHEN {again}<1/3::DOUBLE THEN [0,1] ELSE [0] END) AS pos FROM labels))"""
