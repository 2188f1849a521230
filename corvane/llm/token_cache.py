"""Operator 4, token counts through a digest cache.

The cache is a Parquet table (digest, version, n_tokens): sha256 of the content, and sha256 of the
tokenizer file with the settings that decide its output. Contents without an entry are encoded
once each, however many rows hold them, and appended; then every row takes its count by digest.

Rows of a partition with equal content are joined first (`Combiner`), so a content that fills a
third of the table has one row per partition in the join, not a third of the rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Combiner, columns, pieces

CACHE = "digest binary, version string, n_tokens long"


@lru_cache(maxsize=8)
def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(b"no added tokens\n" + f.read()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str):
    """texts -> token counts, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        pieces_ = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces_.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(tok.encode(x, add_special_tokens=False).ids) for x in texts]


def _combined(df: DataFrame, with_body: bool, max_bytes: int) -> DataFrame:
    """Per partition and content: digest, n_bytes and the ids, or the packed content."""
    names = [("digest", pa.binary())] + (
        [("body", pa.binary())] if with_body else [("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64()))])
    ddl = "digest binary, body binary" if with_body else "digest binary, n_bytes long, ids array<long>"

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        groups = Combiner(max_bytes=max_bytes)

        def flush():
            rows = list(groups.take())
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                cols = [[r[0] for r in part]]
                cols += [[pack(r[1]) for r in part]] if with_body else [[len(r[1]) for r in part], [r[2] for r in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names)], schema=pa.schema(names))

        for b in pieces(batches, 4 << 20):
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if groups.add(row_id, text.encode()):
                    yield from flush()
        yield from flush()

    return df.mapInArrow(run, ddl)


def _encode(path: str, version: str):
    schema = pa.schema([("digest", pa.binary()), ("version", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        count = counter(path)
        for b in pieces(batches, 2 << 20):
            unpack = zstandard.ZstdDecompressor()
            texts = [unpack.decompressobj().decompress(x).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array([version] * b.num_rows),
                                              pa.array(count(texts), pa.int64())], schema=schema)

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, empty where the folder does not exist yet; two writers may have stored a count twice."""
    there = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(df: DataFrame, path: str, cache: str, row_id: str = "doc_id", text: str = "text",
                 max_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens. Appends the counts it had to make to `cache`.

    A null text is empty: no bytes, no tokens. Null ids, repeated rows and empty tables are allowed.
    """
    spark, version = df.sparkSession, tokenizer_version(path)
    rows = columns(df, row_id, text)
    known = read_cache(spark, cache).filter(F.col("version") == version).select("digest")
    misses = (
        _combined(rows, True, max_bytes).join(known, "digest", "left_anti")
        .groupBy("digest").agg(F.first("body").alias("body"))
    )
    misses.mapInArrow(_encode(path, version), CACHE).write.mode("append").parquet(cache)
    counts = (
        read_cache(spark, cache).filter(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    found = _combined(rows, False, max_bytes).join(counts, "digest")
    return found.select(F.explode("ids").alias("id"), "n_bytes", "n_tokens")
