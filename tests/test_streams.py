"""Streams dealt over several triggers."""

import random

from pyspark.sql import functions as F

from corvane.plans import q_streams
from corvane.session import scratch_path
from corvane.streaming import streams as ST


def dealt(spark, parts, schema, name):
    """The parts as files of a stream, one a trigger, in this order."""
    src = scratch_path(spark, name)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)


def test_ingest_keeps_keys_over_triggers(spark):
    schema = "id long, v string"
    parts = [[(1, "a"), (2, "a"), (2, "a")], [(2, "b"), (3, "b")], [(1, "c"), (4, "c"), (9, "c"), (None, "c")], [(None, "d")]]
    out = scratch_path(spark, "ingest")
    done = spark.createDataFrame([(9,)], "id long")
    ST.ingest_incremental(dealt(spark, parts, schema, "ingest-in"), done, "id", out)
    got = sorted(spark.read.parquet(f"{out}/data").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (None, "c")], key=lambda r: f"Row(id={r[0]}, v={r[1]!r})")


def test_turns_out_of_order_over_triggers(spark):
    """Turns that triggers deal out of order, within the delay, are decided as if they had come in order."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(c, t, None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for c in range(6) for t in range(20)]
    at = lambda t: 1_700_000_000 + 60 * t
    want, shuffled = {}, sorted(rows, key=lambda r: r[1] + 3.9 * rng.random())
    for c in range(6):
        texts = [(x or "").split() for i, _, x in rows if i == c]
        votes = ST._TopicTurns(0, 4, 3, 0.35, 0.2, 5.0, 2.0)
        want |= {(c, t): votes.vote(t + 1, texts[t], set(texts[0])) for t in range(1, 16)}
    parts = [[(c, t, x, at(t)) for c, t, x in shuffled[i:i + 30]] for i in range(0, len(shuffled), 30)]
    stream = dealt(spark, parts, "conv_id long, turn long, text string, s long", "turns-in").withColumn("at", F.timestamp_seconds("s"))
    out = scratch_path(spark, "turns-out")
    with ST.disk_state(spark):
        ST.run_to_files(ST.topic_switch_in_order(stream, "at", "4 minutes", 3_600_000), out)
    got = {(r.conv_id, r.turn): (r.vote, r.escalate) for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == want


def test_a_table_arrives_from_a_file_or_from_a_folder_of_files(spark):
    sf = scratch_path(spark, "tables")
    table = spark.range(40).withColumn("v", F.col("id") % 3)
    table.repartition(4).write.parquet(f"{sf}/folder.parquet")
    table.coalesce(1).write.parquet(f"{sf}/_one")
    one = spark.read.parquet(f"{sf}/_one").inputFiles()[0]
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(one).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.rename(jvm.Path(one), jvm.Path(f"{sf}/file.parquet"))
    for name in ("folder", "file"):
        out = scratch_path(spark, "arrived")
        ST.run_to_files(q_streams.arriving(spark, sf, name), out)
        assert sorted(r.id for r in spark.read.parquet(f"{out}/data").collect()) == list(range(40))


def test_ingest_deals_a_large_table_to_more_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(q_streams.S, "append_log", lambda df, path: (made.append(df.rdd.getNumPartitions()), df.write.mode("append").json(path)))
    many = spark.range(60).selectExpr("id doc_id", "'t' text", "'en' lang", "'s' source").repartition(9)
    monkeypatch.setattr(q_streams, "table", lambda spark, sf, name: many if name == "documents" else many.filter("doc_id < 5").select("doc_id"))
    assert q_streams.st1(spark, "none").count() == 55
    assert made == [9]
