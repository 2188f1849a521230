"""Operator 13 against the tree built in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from corvane.llm.sharding import GRID, SHARE, kd_shards, literal_rows

DIMS = ("source", "lang", None, "doc_id")


def number(v):
    if v is None:
        return None
    return float(int(v.encode()[:6].ljust(6, b"\0").hex(), 16)) if isinstance(v, str) else float(v)


def brute(rows, shards):
    """{row number: shard}; rows are (doc_id, text, source, lang)."""
    docs = []
    for i, (doc, text, source, lang) in enumerate(rows):
        body = (text or "").encode()
        digest = int(hashlib.sha256(body).hexdigest()[:15], 16)
        docs.append({"i": i, "size": len(body) + 16, "digest": digest, "id": doc,
                     "d": [number(source), number(lang), float(len(body) + 16), number(doc)]})
    ends = [[x["d"][j] for x in docs if x["d"][j] is not None] for j in range(4)]
    limit = sum(x["size"] for x in docs) // (shards * SHARE)
    groups = defaultdict(list)
    for x in docs:
        groups[x["digest"]].append(x)
    for same in groups.values():
        heavy = sum(x["size"] for x in same) > limit
        for x in same:
            d = x["d"] if heavy else [min((y["d"][j] for y in same if y["d"][j] is not None), default=None) for j in range(4)]
            x["c"] = [0 if v is None or min(e) == max(e) else int((v - min(e)) / (max(e) - min(e)) * float(GRID)) for v, e in zip(d, ends)]
            x["tie"] = ((-1 if x["id"] is None else x["id"]), x["i"]) if heavy else (0, 0)
    out = {}

    def cut(part, first, k):
        if k == 1 or not part:
            out.update({x["i"]: first for x in part})
            return
        spans = [max(x["c"][j] for x in part) - min(x["c"][j] for x in part) for j in range(4)]
        j = spans.index(max(spans))
        units = defaultdict(list)
        for x in part:
            units[(x["c"][j], x["digest"], x["tie"])].append(x)
        total, at, left, right = sum(x["size"] for x in part), 0, [], []
        for key in sorted(units):
            w = sum(x["size"] for x in units[key])
            (left if 2 * k * at + k * w <= 2 * total * (k // 2) else right).extend(units[key])
            at += w
        cut(left, first, k // 2)
        cut(right, first + k // 2, k - k // 2)

    cut(docs, 0, shards)
    return out


def check(spark, rows, shards):
    schema = "doc_id long, text string, source string, lang string, id string, size double, node int, digest string, v int"
    df = spark.createDataFrame([(*r, "k", 1.0, 1, "d", 2) for r in rows], schema).coalesce(1)
    got = kd_shards(df, shards=shards, dims=DIMS).collect()
    want = brute(rows, shards)
    key = lambda r: tuple(map(str, r))
    expect = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "bytes", want[i], None) for i, r in enumerate(rows)]
    assert sorted(((r.id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=key) == sorted(expect, key=key)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return got


def test_many_rows_and_copies(spark):
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(words[(i * k) % 4] for k in range(i * 7919 % 90)), f"src{i * 31 % 11}", ["en", "de", None][i % 3]) for i in range(900)]
    rows += [(1000 + i, "one hot text", "src3", "en") for i in range(450)] + [(2000 + i, f"pair {i // 2} of texts", f"src{i}", "fr") for i in range(60)]
    got = check(spark, rows, 7)
    sizes, pairs = defaultdict(int), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        if r.id >= 2000:
            pairs[r.id // 2].add(r.shard)
    assert all(len(p) == 1 for p in pairs.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text, None, None) for r in odd.select("doc_id", "text").collect()]
    check(spark, rows, 3)
    check(spark, rows, 40)
    check(spark, [(None, None, None, None)] * 30 + [(1, "x", "", "")], 4)
    check(spark, [(5, "same", "s", "l")] * 50, 6)


@pytest.mark.parametrize("dims", [("n",), ("t", "d"), ("b", None)])
def test_kinds_of_dimensions(spark, dims):
    df = spark.range(200).selectExpr("id doc_id", "repeat('x', cast(id % 7 as int)) text",
                                     "case id % 4 when 0 then double('NaN') when 1 then double('Infinity') when 2 then null else -id / 3 end n",
                                     "timestamp_seconds(id) t", "date_add(date'2020-01-01', cast(id as int)) d", "cast(id % 3 as decimal(10,2)) b")
    got = kd_shards(df, dims=dims, shards=5).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert len(got) == 200 and max(sizes) - min(sizes) <= 60


def test_plan_is_native(spark, docs):
    plan = kd_shards(docs, shards=3)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    assert literal_rows(spark, ["a", "b"], [(1, 2 ** 60)]).collect() == [(1, 2 ** 60)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert kd_shards(none).count() == 0
