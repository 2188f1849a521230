"""Helpers shared by the operators of this package.

Row identity: a row is known by its id and its text, never by extra columns, so an operator
selects the columns it needs under names of its own and clashing extra columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.base import table  # noqa: F401
from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, fixes rows that two
    later branches must agree on, and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, text) with a null text as the empty one."""
    return df.select(F.col(f"`{row_id}`").cast("long").alias("id"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece has about max_bytes, or a single row."""
    for b in batches:
        if b.num_rows and b.nbytes > max_bytes:
            size = np.zeros(b.num_rows, np.int64)
            for c in b.columns:
                if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                    size += np.asarray(pa.compute.fill_null(pa.compute.binary_length(c), 0))
            cut = np.flatnonzero(np.diff(np.cumsum(size) // max_bytes)) + 1
            ends = [0, *cut.tolist(), b.num_rows]
            for i, j in zip(ends, ends[1:]):
                yield b.slice(i, j - i)
        elif b.num_rows:
            yield b


class Combiner:
    """Rows of one partition joined by equal content: digest -> the contents that share it, each
    with its ids. Emptied when it holds max_bytes, so memory is bounded; a content that comes back
    later simply makes another row."""

    def __init__(self, digest=None, max_bytes: int = 32 << 20):
        self.digest = digest or (lambda b: hashlib.sha256(b).digest())
        self.max_bytes = max_bytes
        self.clear()

    def clear(self) -> None:
        self.rows, self.size = {}, 0

    def add(self, row_id, content: bytes) -> bool:
        """True when it is time to take the rows."""
        d = self.digest(content)
        for body, ids in self.rows.setdefault(d, []):
            if body == content:
                ids.append(row_id)
                break
        else:
            self.rows[d].append((content, [row_id]))
            self.size += len(content) + 300
        self.size += 40
        return self.size >= self.max_bytes

    def take(self) -> Iterator[tuple[bytes, bytes, list]]:
        for d, same in self.rows.items():
            for body, ids in same:
                yield d, body, ids
        self.clear()
