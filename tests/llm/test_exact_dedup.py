"""Operator 10 against grouping in memory."""

from collections import defaultdict

from corvane.llm.exact_dedup import exact_groups, lower_az


def brute(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[lower_az(r.text)].append(r.doc_id)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, -(x or 0)))
        out += [(i, ids[0], len(ids), k == 0) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def rows(df, **kw):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df, **kw).collect()), key=str)


def test_odd_rows(odd):
    assert rows(odd) == brute(odd)


def test_weak_digest_and_small_memory(docs, odd):
    for df in (docs, odd):
        assert rows(df, digest=lambda b: b[:1], max_bytes=2000, salts=3) == brute(df)


def test_only_a_to_z_is_lowered():
    assert lower_az("ÄBCK") == "ÄbcK".encode()


def test_hot_text(spark):
    df = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', cast(id as string)) text").repartition(7)
    got = rows(df)
    assert got == brute(df) and sum(r[3] for r in got) == 2001


def test_empty(empty):
    assert exact_groups(empty).count() == 0
