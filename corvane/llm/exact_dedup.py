"""Operator 10, exact duplicates by skew-safe combining.

1. Local: each partition joins its equal texts (`Combiner`), so a text sends one row per
   partition however often it occurs. Digests find the candidates, whole contents decide.
2. Salted: rows of a digest are dealt over `salts` groups and joined there by (digest, salt,
   content).
3. Global: at most `salts` winners of a text are joined by (digest, content).

The local rows are written once with a key of their own; the later stages carry lists of those
keys, never document ids, so what a group holds is bounded by the number of partitions. Answers
go back along the keys: a join on unique keys, with no hot side.

Contents travel packed. Packing is one-to-one, so different contents never compare as equal; equal
ones compare as equal as long as all workers run the same library, as Spark's workers do.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Combiner, columns, pieces, stored

LOCAL = "key long, digest binary, body binary, max_id long, n long, ids array<long>"
LOCAL_ARROW = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("max_id", pa.int64()),
                         ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])


def lower_az(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _local(digest, max_bytes):
    def run(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        groups, packed = Combiner(digest, max_bytes), zstandard.ZstdCompressor(level=3).compress

        def flush():
            nonlocal made
            rows = list(groups.take())
            for i in range(0, len(rows), 2000):
                part = [(d, packed(b), sorted(ids, key=lambda x: (x is None, -(x or 0)))) for d, b, ids in rows[i:i + 2000]]
                keys = list(range(base + made, base + made + len(part)))
                made += len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array([p[0] for p in part], pa.binary()),
                    pa.array([p[1] for p in part], pa.binary()), pa.array([p[2][0] for p in part], pa.int64()),
                    pa.array([len(p[2]) for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.list_(pa.int64()))], schema=LOCAL_ARROW)

        for b in pieces(batches, 4 << 20):
            for row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if groups.add(row_id, lower_az(text)):
                    yield from flush()
        yield from flush()

    return run


def exact_groups(df: DataFrame, row_id: str = "doc_id", text: str = "text", salts: int = 32, digest=None,
                 max_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts
    are equal. The greatest id of a group stays; a null id ranks below all others. Where several
    rows of a group share the greatest id, exactly one of them is `kept`. An empty table gives an
    empty result. `digest` (bytes -> bytes) only finds candidates; a weak one changes nothing.
    """
    local = stored(columns(df, row_id, text).mapInArrow(_local(digest, max_bytes), LOCAL), "exact-local")
    win = F.max(F.struct("max_id", "key")).alias("win")
    salted = (
        local.withColumn("salt", F.pmod(F.hash("key"), F.lit(salts)))
        .groupBy("digest", "salt", "body").agg(win, F.sum("n").alias("n"), F.collect_list("key").alias("keys"))
    )
    whole = salted.groupBy("digest", "body").agg(
        F.max("win").alias("win"), F.sum("n").alias("n"), F.flatten(F.collect_list("keys")).alias("keys"))
    answer = whole.select(F.col("win.max_id").alias("keep_id"), F.col("win.key").alias("first_key"),
                          F.col("n").alias("group_size"), F.explode("keys").alias("key"))
    back = local.select("key", "digest", "ids").join(answer, "key")
    return back.select(
        "keep_id", "group_size", "digest", "key", "first_key", F.posexplode("ids").alias("pos", "id")
    ).select("id", "keep_id", "group_size", ((F.col("key") == F.col("first_key")) & (F.col("pos") == 0)).alias("kept"),
             "digest")
