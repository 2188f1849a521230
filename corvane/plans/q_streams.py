"""Queries ST1-ST5: the stream forms, run over the given tables as files arriving."""

from pyspark.sql import functions as F

from ..functions.rules import accept, is_sensitive
from ..operators import models as M
from ..session import scratch_path
from ..sources import files as S
from ..streaming import streams as ST
from .base import META, query, table
from .q_eval import SQL_TOK
from .q_models import SQL_HEAD, centroid_head
from .q_sources import DOC_SCHEMA


def arriving(spark, sf, name):
    """A given table's file as a stream."""
    if name == "events":  # event time must be an instant
        return _files(spark, sf, name).withColumn("ts", F.col("ts").cast("timestamp"))
    return _files(spark, sf, name)


def _files(spark, sf, name):
    """A table is one file or a folder of files. The path is a pattern, since a stream takes a plain one for a folder only."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("st1_ingest_incremental", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def st1(spark, sf):
    src, out = scratch_path(spark, "st1-in"), scratch_path(spark, "st1-out")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    # files as many as the table has splits, four at least: no task writes or reads more than a split's share
    S.append_log(docs.repartition(max(4, docs.rdd.getNumPartitions())), src)
    stream = spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", 2).json(src)
    ST.ingest_incremental(stream, table(spark, sf, "labels"), "doc_id", out)
    return spark.read.parquet(f"{out}/data").select("doc_id", "lang")


@query("st2_stream_exact_dedup", "SELECT DISTINCT user_id, event_type, props FROM events")
def st2(spark, sf):
    out = scratch_path(spark, "st2")
    keys = ["user_id", "event_type", "props"]
    ST.run_to_files(ST.stream_exact_dedup(arriving(spark, sf, "events"), keys, "ts", "3650 days").select(*keys), out)
    return spark.read.parquet(f"{out}/data").select(*keys)


@query("st3_stream_score", f"""WITH {SQL_HEAD}, m AS (SELECT id, max(z) AS mx FROM lg GROUP BY id), p AS (SELECT id, arg_min(label,(-z,label)) AS pred, 1/sum(exp((z-mx)/0.1::DOUBLE)) AS conf FROM lg JOIN m USING (id) GROUP BY id)
 SELECT id, pred, conf>=CASE WHEN pred IN (7,8,9) THEN 0.7 ELSE 0.5 END AS accepted FROM p""")
def st3(spark, sf):
    out = scratch_path(spark, "st3")
    stream = arriving(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    def decide(df):
        s = M.softmax_t(df, "z", 0.1)
        return s.select("id", "pred", accept(F.col("conf"), is_sensitive(F.col("pred"), META), 0.5, 0.7).alias("accepted"))

    ST.run_to_files(ST.stream_score(stream, M.head_udf(centroid_head(spark, sf))(F.col("vec")), decide), out)
    return spark.read.parquet(f"{out}/data")


@query("st4_stream_topic_switch", f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {SQL_TOK.format('text')} AS tm FROM conversations WHERE role='user'),
 f AS (SELECT conv_id, list_distinct(tm) AS ta FROM u WHERE k=1), j AS (SELECT u.conv_id, turn, k, len(tm) AS words, list_distinct(tm) AS tb, ta, len(list_intersect(ta,list_distinct(tm))) AS sh FROM u JOIN f USING (conv_id) WHERE k>1),
 s AS (SELECT *, words<4 OR k<3 AS guard, CASE WHEN 0.25*sh>=5 THEN 'same' WHEN 0.25*sh<=2 THEN 'new' ELSE 'unsure' END AS b,
  CASE WHEN sh/sqrt(len(ta)*len(tb))>=0.35 THEN 'same' WHEN sh/sqrt(len(ta)*len(tb))<=0.2 THEN 'new' ELSE 'unsure' END AS c FROM j)
 SELECT conv_id, turn, CASE WHEN NOT guard AND b='new' AND c='new' THEN 'new' ELSE 'same' END AS vote, NOT guard AND b<>'same' AND c<>'same' AND NOT (b='new' AND c='new') AND (b='new' OR c='new') AS escalate FROM s""")
def st4(spark, sf):
    out = scratch_path(spark, "st4")
    stream = arriving(spark, sf, "conversations").filter("role = 'user'").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60))
    ST.run_to_files(ST.topic_switch(stream, "at", "30 days"), out)
    return spark.read.parquet(f"{out}/data")


@query("st4_topic_switch_in_order", f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {SQL_TOK.format('text')} AS tm FROM conversations WHERE role='user'),
 f AS (SELECT conv_id, list_distinct(tm) AS ta FROM u WHERE k=1), j AS (SELECT u.conv_id, turn, k, len(tm) AS words, list_distinct(tm) AS tb, ta, len(list_intersect(ta,list_distinct(tm))) AS sh FROM u JOIN f USING (conv_id) WHERE k>1),
 s AS (SELECT *, words<4 OR k<3 AS guard, CASE WHEN 0.25*sh>=5 THEN 'same' WHEN 0.25*sh<=2 THEN 'new' ELSE 'unsure' END AS b,
  CASE WHEN sh/sqrt(len(ta)*len(tb))>=0.35 THEN 'same' WHEN sh/sqrt(len(ta)*len(tb))<=0.2 THEN 'new' ELSE 'unsure' END AS c FROM j)
 SELECT conv_id, turn, CASE WHEN NOT guard AND b='new' AND c='new' THEN 'new' ELSE 'same' END AS vote, NOT guard AND b<>'same' AND c<>'same' AND NOT (b='new' AND c='new') AND (b='new' OR c='new') AS escalate
 FROM s WHERE turn<=(SELECT max(turn)-1 FROM u)""")
def st4_ordered(spark, sf):
    out = scratch_path(spark, "st4o")
    stream = arriving(spark, sf, "conversations").filter("role = 'user'").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60))
    with ST.disk_state(spark):
        ST.run_to_files(ST.topic_switch_in_order(stream, "at", "1 minute", 600_000), out)
    return spark.read.parquet(f"{out}/data")


@query("st5_windowed_decision_metrics", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS s, count(*) AS n, round(avg((event_type<>'error')::INT),9) AS coverage, round(avg(value) FILTER (event_type<>'error'),6) AS mean_value FROM events GROUP BY 1)
 SELECT strftime(s,'%Y-%m-%d %H:%M') AS hour, n, coverage, mean_value FROM w WHERE s+INTERVAL 1 HOUR <= (SELECT max(ts)::TIMESTAMP-INTERVAL 10 MINUTE FROM events)""")
def st5(spark, sf):
    out = scratch_path(spark, "st5")
    ok = F.col("event_type") != "error"
    m = ST.windowed_decision_metrics(arriving(spark, sf, "events"), "ts", "10 minutes", "1 hour", ok, F.col("value"))
    ST.run_to_files(m, out)
    return spark.read.parquet(f"{out}/data").select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("coverage", 9).alias("coverage"), F.round("mean_value", 6).alias("mean_value"))
