"""Keyed vector files: `<name>.keys` (one key per line) beside `<name>.f32` (little-endian floats)."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import numbered_lines
from .paths import make_folder, move, open_path

RANGE_BYTES = 64 << 20   # read at once, whatever the dimension


def read_keyed_f32(spark: SparkSession, path: str, dim: int, rows_per_range: int | None = None) -> DataFrame:
    """(key, vec). The vectors are read as byte ranges of the .f32 files, the keys as numbered
    lines of the .keys files; the two meet on (file, row number). A file with more vectors than
    keys, or fewer, is an error."""
    rows_per_range = rows_per_range or max(1, RANGE_BYTES // (4 * dim))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.f32").load(path).select(
        F.col("path").alias("file"), (F.col("length") / (4 * dim)).cast("bigint").alias("n"))
    ranges = files.filter("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(rows_per_range))).alias("first"))

    def load(batches):
        for b in batches:
            for file, n, first in zip(*(b.column(c).to_pylist() for c in ("file", "n", "first"))):
                count = min(rows_per_range, n - first)
                with open_path(file, "rb") as f:
                    f.seek(first * 4 * dim)
                    flat = np.frombuffer(f.read(count * 4 * dim), "<f4")
                for i in range(0, count, 8192):
                    block = flat[i * dim:(i + 8192) * dim]
                    rows = len(block) // dim
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file[:-4]] * rows), pa.array(np.arange(first + i, first + i + rows)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) + 1, dim, dtype=np.int32)), pa.array(block))],
                        names=["stem", "row_no", "vec"])

    vecs = ranges.repartition("file", "first").mapInArrow(load, "stem string, row_no bigint, vec array<float>")
    lines = numbered_lines(spark.read.option("pathGlobFilter", "*.keys"), path)
    keys = lines.select(F.regexp_replace("file", r"\.keys$", "").alias("stem"), F.col("line_no").alias("row_no"), F.col("value").alias("key"))
    return paired(vecs, keys)


def paired(vecs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, vec) of rows that agree in (stem, row_no); a row without a partner is an error."""
    def same(df):  # listings name local files as file:/x or file:///x
        return df.withColumn("stem", F.regexp_replace("stem", "^file:/+", "/"))

    joined = same(vecs).join(same(keys), ["stem", "row_no"], "full")
    both = F.col("key").isNotNull() & F.col("vec").isNotNull()
    complain = F.raise_error(F.concat(F.lit("keys and vectors differ in number: "), F.col("stem")))
    return joined.select(F.when(both, F.col("key")).otherwise(complain).alias("key"), "vec")


def write_keyed_f32(df: DataFrame, path: str, key: str, vec: str) -> int:
    """One pair of files per partition in a shared folder. A file is renamed into place when
    complete and named by its partition, so a repeated task overwrites its own output."""
    make_folder(path)

    def write(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        stem, tmp = f"{path}/part-{ctx.partitionId():06d}", f"{path}/_tmp-{ctx.taskAttemptId()}"
        n = 0
        with open_path(tmp + ".k", "wb") as keys, open_path(tmp + ".v", "wb") as vals:
            for pdf in batches:
                keys.write("".join(f"{k}\n" for k in pdf["k"]).encode())
                if len(pdf):
                    vals.write(np.stack(pdf["v"].to_numpy()).astype("<f4").tobytes())
                n += len(pdf)
        move(tmp + ".k", stem + ".keys")
        move(tmp + ".v", stem + ".f32")
        yield pd.DataFrame({"n": [n]})

    chosen = df.select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v"))
    return chosen.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]
