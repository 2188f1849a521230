"""Vector files of numpy: `<name>.npy` beside `<name>.ids.json`, a JSON array with the id of every row."""

import codecs
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing
from .keyed_f32 import RANGE_BYTES, paired
from .paths import make_folder, open_path

BATCH = 8192            # rows given to Spark at once
CHARS = 1 << 20         # of an id file read at once
IDS = ".ids.json"


def _header(file) -> tuple[int, int, np.dtype]:
    """Rows, columns and type; the file stands at the first number afterwards."""
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
    shape, fortran, dtype = read(file)
    if len(shape) != 2 or dtype.kind not in "fiu" or (fortran and min(shape) > 1):
        raise ValueError(f"no table of numbers by rows: shape {shape}, type {dtype}, columns first: {fortran}")
    return shape[0], shape[1], dtype


def json_items(file):
    """The elements of a file that holds one JSON array, decoded while it is read."""
    text, decode = codecs.getreader("utf-8")(file), json.JSONDecoder().raw_decode
    rest, at, end = "", 0, False
    opened = False
    while True:
        while at < len(rest) and rest[at] in " \t\r\n,":
            at += 1
        if not opened and at < len(rest):
            if rest[at] != "[":
                raise ValueError("ids are not a JSON array")
            opened, at = True, at + 1
            continue
        if opened and at < len(rest) and rest[at] == "]":
            return
        try:
            item, after = decode(rest, at) if at < len(rest) else (None, None)
        except json.JSONDecodeError:
            if end:
                raise
            after = None
        if after is not None and rest[after:after + 1] in tuple(" \t\r\n,]"):  # a number at the end of a chunk may go on
            yield item
            at = after
            continue
        if end:
            raise ValueError("the JSON array does not end")
        more = text.read(CHARS)
        rest, at, end = rest[at:] + more, 0, not more


def read_npy(spark: SparkSession, path: str, element: str = "float", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, vec) of all .npy files under a folder. Headers are read first, then byte ranges in tasks of their own, and ids
    while their file is decoded, so no task holds a file. Ids are given as strings. An id without a row, or a row without
    an id, is an error; a file without rows gives none."""

    def ranges(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with open_path(p, "rb") as f:
                    n, dim, dtype = _header(f)
                    offset = f.tell()
                step = max(1, range_bytes // max(1, dim * dtype.itemsize))
                first = np.arange(0, n, step)
                size = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * size, pa.string()), pa.array(first + 0, pa.int64()), pa.array(np.minimum(step, n - first), pa.int64()),
                     pa.array([dim] * size, pa.int64()), pa.array([dtype.str] * size, pa.string()), pa.array([offset] * size, pa.int64())],
                    names=["path", "first", "n", "dim", "type", "offset"])

    width = {"float": "<f4", "double": "<f8"}[element]

    def load(batches):
        for b in batches:
            for r in b.to_pylist():
                dtype, dim = np.dtype(r["type"]), r["dim"]
                with open_path(r["path"], "rb") as f:
                    f.seek(r["offset"] + r["first"] * dim * dtype.itemsize)
                    for i in range(0, r["n"], BATCH):
                        rows = min(BATCH, r["n"] - i)
                        flat = np.frombuffer(f.read(rows * dim * dtype.itemsize), dtype).astype(width)
                        if len(flat) != rows * dim:
                            raise ValueError(f"{r['path']} ends before its last row")
                        start = r["first"] + i
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["path"][:-4]] * rows), pa.array(np.arange(start, start + rows)),
                             pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(flat))],
                            names=["stem", "row_no", "vec"])

    def number(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with open_path(p, "rb") as f:
                    start, keys = 0, []
                    for item in json_items(f):
                        keys.append(item if isinstance(item, str) else json.dumps(item))
                        if len(keys) == BATCH:
                            yield _keys(p, start, keys)
                            start, keys = start + len(keys), []
                    yield _keys(p, start, keys)

    tasks = spark.sparkContext.defaultParallelism
    cuts = listing(spark, path, "*.npy").select("path").repartition(tasks, "path").mapInArrow(
        ranges, "path string, first bigint, n bigint, dim bigint, type string, offset bigint")
    vecs = cuts.repartition("path", "first").mapInArrow(load, f"stem string, row_no bigint, vec array<{element}>")
    keys = listing(spark, path, "*" + IDS).select("path").repartition(tasks, "path").mapInArrow(
        number, "stem string, row_no bigint, key string")
    return paired(vecs, keys)


def _keys(path: str, start: int, keys: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path[:-len(IDS)]] * len(keys), pa.string()), pa.array(np.arange(start, start + len(keys)), pa.int64()),
         pa.array(keys, pa.string())], names=["stem", "row_no", "key"])


def write_npy(df: DataFrame, path: str, key: str, vec: str) -> int:
    """Pairs of files in a shared folder, one pair per batch of a task, named by partition and batch: a repeated task
    overwrites its own files. Gives the number of rows."""
    make_folder(path)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            if b.num_rows:
                flat = np.asarray(b.column("v").flatten())
                stem = f"{path}/part-{part:06d}-{i:06d}"
                with open_path(stem + ".npy", "wb") as f:
                    np.lib.format.write_array(f, flat.reshape(b.num_rows, -1))
                with open_path(stem + IDS, "wb") as f:
                    f.write(json.dumps(b.column("k").to_pylist()).encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    chosen = df.select(F.col(key).alias("k"), F.col(vec).alias("v"))
    return chosen.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
