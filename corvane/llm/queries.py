"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, licenses, secrets, toxicity
from .common import LOWER, UPPER, table
from .exact_dedup import exact_groups
from .ngram_join import ngram_components
from .packing import pack
from .periods import contract_change, periodic_runs
from .sharding import kd_shards
from .sql import licenses_sql, secrets_sql, shards_sql
from .suffixes import repeated_passages
from .token_cache import count_tokens
from .vector_index import near_duplicates
from .whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op8_embedding_near_dup")
def op8(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"), cosine=0.9).withColumnRenamed("id", "vec_id")


@query("op9_ngram_jaccard")
def op9(spark, sf):
    rows = ngram_components(table(spark, sf, "documents"), n=3, num=90, den=100)
    return rows.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), "component_id")


@query("op10_exact_dedup", f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
 SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256 FROM t""")
def op10(spark, sf):
    rows = exact_groups(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


@query("op1_license_scans", licenses_sql())
def op1(spark, sf):
    return licenses.scan(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_secret_scans", secrets_sql())
def op5(spark, sf):
    rows = secrets.scan(table(spark, sf, "documents"))
    counts = [secrets.count_kind("base", k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.span_text("base"), 256).alias("base_sha256"),
                       secrets.span_text("spans").alias("spans"), "n_example", "n_live")


@query("op2_suffix_array_dedup")
def op2(spark, sf):
    return repeated_passages(table(spark, sf, "documents"), least=50).withColumnRenamed("id", "doc_id")


@query("op3_toxicity")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                       toxicity.score_column(spark, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op4_token_counts")
def op4(spark, sf):
    counts = count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                          scratch_path(spark, "token-cache"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op6_byte_bpe")
def op6(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.decode(bpe.encode(table(spark, sf, "documents"), path), path)
    return rows.select(F.col("id").alias("doc_id"), bpe.token_count(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("body", 256).alias("decoded_sha256"))


@query("op7_packing")
def op7(spark, sf):
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@query("op11_periodic_runs")
def op11(spark, sf):
    return periodic_runs(table(spark, sf, "documents"), change=contract_change).withColumnRenamed("id", "doc_id")


@query("op12_embedding_whitening")
def op12(spark, sf):
    return whiten(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op13_sharding", shards_sql())
def op13(spark, sf):
    return kd_shards(table(spark, sf, "documents"), shards=40).withColumnRenamed("id", "doc_id")
