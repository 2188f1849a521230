"""Prepares a corpus for training: toxic documents go, then exact copies, then near copies; live secrets
are blanked; what is left is tokenised and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next stage's docs; all but the
last keep the columns of `documents`, extra ones too. Null ids and texts, empty texts and empty
tables pass through every stage; what each stage does with them is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import secrets, toxicity
from corvane.llm.common import LOWER, UPPER, stored, table
from corvane.llm.exact_dedup import exact_groups
from corvane.llm.ngram_join import ngram_components
from corvane.llm.packing import pack


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; the model is learnt on this stage's input. A null text is scored as
    an empty one and stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, null ones being empty, the row with the greatest id; one row
    where rows of a group share it. Rows without an id stay behind those with one."""
    none = F.lit(-(1 << 63))  # stands for a null id in the join; a group's kept id is null only if all its ids are
    kept = exact_groups(docs).filter("kept").select(F.coalesce("id", none).alias("__id"), F.lower(F.hex("digest")).alias("__digest"))
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    met = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), none)).withColumn("__digest", digest).join(kept, ["__id", "__digest"])
    return met.dropDuplicates(["__id", "__digest"]).select(docs.columns)  # falls on the join's partitions, so the texts move once


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on shingles of five words, directly or through
    others, the one with the least id. Documents without words or without an id stay. Rows that share an
    id stay if one of them does."""
    marked = ngram_components(docs, n=5, num=80, den=100)
    gone = marked.filter("id is not null").groupBy("id").agg(F.max("kept").alias("kept")).filter("not kept")
    return docs.join(gone.select(F.col("id").alias("__gone_id")), F.col("doc_id") == F.col("__gone_id"), "left_anti")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets that belong to few owners are replaced in the texts, named ones of any form, widely
    copied examples stay. n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; a null text is one end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

# A learnt score and a tokenizer stand in the way of SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
