"""Readers of bytes: numpy files with their ids, and checksums of files taken in chunks."""

import hashlib
import io
import json

import numpy as np
import pytest

from corvane.sources import files as S
from corvane.sources import npy


def save(folder, name, rows, ids, **kw):
    with open(folder / f"{name}.npy", "wb") as f:
        np.lib.format.write_array(f, rows, **kw)
    (folder / f"{name}.ids.json").write_text(json.dumps(ids))


def test_npy_ranges_meet_their_ids(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(25, 3)), rng.normal(size=(7, 3)).astype("<f4")
    save(tmp_path, "a", a, [f"k,{i}" for i in range(25)], version=(2, 0))
    save(tmp_path, "b", b, list(range(100, 107)))
    save(tmp_path, "none", np.zeros((0, 3)), [])
    got = {r["key"]: r["vec"] for r in npy.read_npy(spark, str(tmp_path), "double", range_bytes=80).collect()}
    assert len(got) == 32
    assert all(got[f"k,{i}"] == list(a[i]) for i in range(25))
    assert all(got[str(100 + i)] == [float(x) for x in b[i]] for i in range(7))


def test_npy_that_differs_from_its_ids_is_refused(spark, tmp_path):
    save(tmp_path, "a", np.zeros((3, 2)), [1, 2])
    with pytest.raises(Exception, match="differ in number"):
        npy.read_npy(spark, str(tmp_path)).collect()
    save(tmp_path, "a", np.zeros(3), [1, 2, 3])
    with pytest.raises(Exception, match="no table of numbers"):
        npy.read_npy(spark, str(tmp_path)).collect()


def test_npy_round_trip(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS k", "array(cast(id AS float), cast(0.5 AS float)) AS v").repartition(3)
    assert npy.write_npy(df, str(tmp_path / "out"), "k", "v") == 500
    assert {(int(r["key"]), r["vec"][0], r["vec"][1]) for r in npy.read_npy(spark, str(tmp_path / "out")).collect()} == {
        (i, float(i), 0.5) for i in range(500)}


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_ids_are_decoded_over_ends_of_chunks(monkeypatch, size):
    ids = ["a", "b]\"[,", 12345, "ö\n", 7, "", 1.5]
    monkeypatch.setattr(npy, "CHARS", size)
    assert list(npy.json_items(io.BytesIO(json.dumps(ids, ensure_ascii=False).encode()))) == ids
    assert list(npy.json_items(io.BytesIO(b" [ ] "))) == []
    for broken in (b"", b"[1, 2", b"{}", b'["a'):
        with pytest.raises(ValueError):
            list(npy.json_items(io.BytesIO(broken)))


def test_checksums_of_files_larger_than_a_chunk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    bodies = {"big.bin": bytes(range(256)) * 40_000, "sub/small.bin": b"x", "empty.bin": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r["file"]: (r["sha256"], r["bytes"]) for r in S.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert got == {n.split("/")[-1]: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items() if b}


def test_a_changed_byte_and_a_missing_file_are_found(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name * 10)
    frozen = spark.createDataFrame(S.file_checksums(spark, str(tmp_path), "*.txt").collect())
    (tmp_path / "a.txt").write_text("a" * 9 + "b")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("")
    found = S.file_checksums(spark, str(tmp_path), "*.txt")
    assert {(r["file"], r["reason"]) for r in S.verify_manifest(found, frozen, "file", "sha256").collect()} == {
        ("a.txt", "differs"), ("b.txt", "missing"), ("c.txt", "missing")}


def test_a_shard_is_one_file_after_a_join_by_shard(spark, tmp_path):
    from pyspark.sql import functions as F

    from corvane.plans.q_sources import _write_shards

    shard = F.concat(F.lit("s-"), F.floor(F.col("id") / 40 % 100))
    spark.range(0, 20000, 1, 16).select("id", shard.alias("shard"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("text")).write.parquet(
        str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    # planned as a sorted join by shard, made a broadcast join at run time: its shuffle is then read by mapper
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in late.items():
        spark.conf.set(k, v)
    try:
        kept = rows.filter("id % 7 = 0").select("shard").distinct()
        got = [r["shard"] for r in _write_shards(spark, rows.join(kept, "shard", "left_semi")).collect()]
    finally:
        for k in late:
            spark.conf.unset(k)
    assert len(set(got)) == len(got) == 100


def test_each_name_becomes_one_plain_file_of_ordered_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    name = F.concat(F.lit("fam=f"), F.col("id") % 7, F.lit("/"), F.floor(F.col("id") / 500), F.lit(".txt"))
    rows = spark.range(0, 5000, 1, 16).select("id", name.alias("file"), F.concat(F.lit("l"), "id").alias("value")).orderBy(F.xxhash64("id"))
    assert S.write_line_files(rows, str(tmp_path / "o"), "file", ["id"]) == 70
    files = [p for p in (tmp_path / "o").rglob("*") if p.is_file()]
    assert sorted(str(p.relative_to(tmp_path / "o")) for p in files) == sorted(f"fam=f{f}/{c}.txt" for f in range(7) for c in range(10))
    for p in files:
        f, c = int(p.parent.name[5:]), int(p.stem)
        assert p.read_text() == "".join(f"l{i}\n" for i in range(500 * c, 500 * c + 500) if i % 7 == f)
    again = spark.read.text(str(tmp_path / "o"))
    assert again.count() == 5000


def test_provenance_files_are_not_a_folder_each(spark):
    """s4's files lie in a folder per source: folders in number of files are what makes listing and committing slow."""
    from pathlib import Path

    from corvane.plans.base import QUERIES
    from corvane.session import shared_folder

    before = set(Path(shared_folder(spark)).glob("s4-*"))
    rows = QUERIES["s4_scan_with_provenance"](spark, "/root/testdata/sf0.01")
    tags = rows.select("tag").distinct().count()
    new, = set(Path(shared_folder(spark)).glob("s4-*")) - before
    assert sum(p.is_dir() for p in new.rglob("*")) == tags


def test_shards_are_files_of_one_folder(spark):
    from corvane.plans.q_sources import _shards, _write_shards

    paths = [r["path"] for r in _write_shards(spark, _shards(spark, "/root/testdata/sf0.01", False)).select("path").collect()]
    assert len(paths) > 20 and len({p.rpartition("/")[0] for p in paths}) == 1
