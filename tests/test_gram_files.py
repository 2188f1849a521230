"""Gram sets that meet many blocks are written once."""

import pathlib

from pyspark.sql import functions as F

from corvane.operators import dedup as D


def test_gram_sets_are_written_once_however_many_blocks_meet(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    text = F.substring(F.sha2(F.col("id").cast("string"), 512), 1, 60)
    q, r = (spark.range(lo, lo + 200).select("id", text.alias("text")).repartition(4) for lo in (0, 1000))
    monkeypatch.setattr(D, "COLUMNS", 8)
    same = spark.createDataFrame([(5000, q.filter("id = 7").first()["text"])], "id long, text string")
    got = D.near_dup_ngram(q, r.unionByName(same), "id", "text", 0.6, block=10).collect()
    assert [(x["id"], x["max_jac"], x["nn_jac"]) for x in got] == [(7, 1.0, 5000)]
    written = sum(D.pa.ipc.open_stream(p.read_bytes()).read_all().num_rows for p in pathlib.Path(tmp_path).glob("grams/*"))
    assert written == 401
