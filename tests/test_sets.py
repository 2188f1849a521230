import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.ranking import cumulate, exact_percentiles, ordinal
from corvane.operators import dedup as D
from corvane.operators import joins as J
from corvane.operators import splits as X
from corvane.sources import files as S


def test_ordinal_on_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    got = {(r["g"], r["id"]): (r["rn"], r["n"]) for r in ordinal(df, ["g"], "x", ["id"], size="n").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == g)
        for k, (_, i) in enumerate(mine):
            assert got[(g, i)] == (k + 1, len(mine))


def test_ordinal_when_all_values_are_equal(spark):
    df = spark.createDataFrame([(5, i) for i in range(50)], "x long, id long")
    assert sorted(r["rn"] for r in ordinal(df, [], "x", ["id"]).collect()) == list(range(1, 51))


def test_running_sums_and_percentiles(spark):
    vals = [random.Random(i).gauss(0, 1) for i in range(500)]
    df = spark.createDataFrame([(v, 1) for v in vals], "v double, n int")
    got = {r["v"]: r["n_before"] for r in cumulate(df, [], "v", ["n"]).collect()}
    assert all(got[v] == k for k, v in enumerate(sorted(vals)))
    p = exact_percentiles(df, "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    assert np.allclose([p["p10"], p["p50"], p["p99"]], np.percentile(vals, [10, 50, 99]))


def test_funnel_copies_of_a_reference_all_count_against_it(spark):
    df = spark.createDataFrame([(1, "a", "aa"), (2, "a", "aa"), (3, "b", "bb"), (4, "b", "bb"), (5, "c", "")], "id long, key string, text string")
    refs = [("old", spark.createDataFrame([("a",), ("b",)], "key string")), ("new", spark.createDataFrame([("a",)], "key string"))]
    one = [("old", refs[0][1].filter("key = 'a'"))]
    got = {r["id"]: r["status"] for r in D.funnel_status(df, "key", "id", "text", one, 1).collect()}
    assert got == {1: "dup_vs_old", 2: "dup_vs_old", 3: "kept", 4: "dup_within", 5: "empty"}
    tags = {r["id"]: r["ref_tag"] for r in J.anti_join_attributed(df, refs, "key").collect()}
    assert tags == {1: "new", 2: "new", 3: "old", 4: "old", 5: None}


def test_funnel_counts_by_key_equal_those_of_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", *[f"k{j}" for j in range(30)]]), rng.choice(["x", "xx", "xxx"]), rng.choice("fgh")) for i in range(500)]
    df = spark.createDataFrame(rows + [(500, None, "xxx", "f"), (501, None, "xxx", "g"), (502, "n", None, "f")], "id long, key string, text string, fam string")
    refs = [("r", spark.createDataFrame([("k1",), ("k2",), (None,)], "key string"))]
    by_row = D.funnel_counts(D.funnel_status(df.fillna({"text": ""}), "key", "id", "text", refs, 2), "status", "fam")
    by_key = D.funnel_counts_by_key(df, "key", "id", "text", refs, 2, "fam")
    assert by_key.columns == by_row.columns and sorted(map(tuple, by_key.collect())) == sorted(map(tuple, by_row.collect()))
    assert D.funnel_counts_by_key(df.limit(0), "key", "id", "text", refs, 2, "fam").count() == 0


def test_exact_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(i, f"k{i % 5}") for i in range(40)], "id long, key string")
    once = D.exact_dedup(df, ["key"], ["id"])
    assert sorted(r["id"] for r in once.collect()) == [0, 1, 2, 3, 4]
    assert D.exact_dedup(once, ["key"], ["id"]).count() == 5


def _jac(a, b):
    def grams(s):
        s = "".join(s.lower().split())
        return {s} if len(s) < 3 else {s[i:i + 3] for i in range(len(s) - 2)}

    a, b = grams(a), grams(b)
    return len(a & b) / max(1, len(a | b))


def test_ngram_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ef") for _ in range(rng.randrange(2, 60))) for _ in range(25)]

    def near(t):
        c = list(t)
        for _ in range(rng.randrange(4)):
            c[rng.randrange(len(c))] = rng.choice("abcdef")
        return "".join(c)

    q = [(i, near(rng.choice(base))) for i in range(60)]
    ref = [(1000 + i, near(rng.choice(base))) for i in range(60)]
    schema = "id long, text string"
    got = {r["id"]: (round(r["max_jac"], 9), r["nn_jac"]) for r in D.near_dup_ngram(
        spark.createDataFrame(q, schema), spark.createDataFrame(ref, schema), "id", "text", 0.6).collect()}
    want = {}
    for i, t in q:
        best = max(((_jac(t, u), -j) for j, u in ref))
        if best[0] > 0.6:
            want[i] = (round(best[0], 9), -best[1])
    assert len(want) > 10
    assert got == want


def test_splits_partition_the_rows(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id long, label string")
    parts = X.per_label_split(df, "label", "id", {"a": 0.5, "b": 0.25, "c": 0.25}, "s")
    n = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert n == {("hot", "a"): 100, ("hot", "b"): 50, ("hot", "c"): 50, ("cold", "a"): 50, ("cold", "b"): 25, ("cold", "c"): 25}
    sizes = [r["count"] for r in X.kfold(df, "id", 7, "s").groupBy("fold").count().collect()]
    assert sum(sizes) == 300 and max(sizes) - min(sizes) <= 1


def test_missing_vectors_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    vecs = spark.createDataFrame([(1, [0.5])], "id long, vec array<float>")
    assert J.attach_vectors(df, vecs, "id").count() == 1
    with pytest.raises(Exception, match="no vector for 2"):
        J.attach_vectors(df, vecs, "id", "fail").collect()


def test_lenient_lines_and_checksums(spark, tmp_path):
    import hashlib

    p = tmp_path / "raw_fam-1.jsonl"
    p.write_text('{"id": 1, "items": [{"text": "a"}]}\n{"id": 2, "items": [{"te\n', encoding="utf-8")
    good, bad = S.read_jsonl_lenient(spark, str(p), "id int, items array<struct<text:string>>")
    assert [r["id"] for r in good.collect()] == [1]
    assert [r["line"] for r in bad.collect()] == ['{"id": 2, "items": [{"te']
    row = S.file_checksums(spark, str(tmp_path), "*.jsonl").first()
    assert row["sha256"] == hashlib.sha256(p.read_bytes()).hexdigest() and row["file"] == p.name
    lines = S.scan_with_provenance(spark, str(p), "id int", r"raw_(\w+)-").collect()
    assert [(r["tag"], r["line_no"]) for r in lines] == [("fam", 0), ("fam", 1)]
