"""Operator 11 against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm.periods import WORD, Minimum, Tree, contract_change, find_runs, periodic_runs, stretches


def brute(w):
    """Every period by itself: stretches where words one period apart are equal, with no smaller period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (None,) * 4
    if runs:
        s, length, p = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0]
        best = s, length, p, 1000 * length // p
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(rng):
    k, n = rng.choice([1, 2, 3, 6]), rng.randint(0, 90)
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        if n > 8:
            a, p, m = rng.randrange(n), rng.randint(1, 9), rng.randint(1, n)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = made(rng)
        assert find_runs(np.array(w, np.int64)) == brute(w), w


def test_longer_limits():
    rng = random.Random(6)
    for _ in range(300):
        w = made(rng)
        assert find_runs(np.array(w, np.int64), 9, 5) == [r for r in brute(w) if r[1] >= max(9, 5 * r[2])]
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int64), 6, 3)


def test_extensions_and_orders():
    rng = random.Random(7)
    for _ in range(60):
        w = [1 + rng.randrange(3) for _ in range(rng.randint(1, 60))]
        t, n = Tree(w, 4), len(w)
        a, b = map(np.array, zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]))
        want = [next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n) for i, j in zip(a, b)]
        assert t.lce(a, b).tolist() == want
        for rising, sign in ((True, 1), (False, -1)):
            order = sorted(range(n + 1), key=lambda i: [sign * x for x in w[i:]])
            assert t.ranks(rising) == np.argsort(order).tolist()


def test_range_minimum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 16, 17, 100, 1000):
        v = rng.integers(0, 50, n)
        a, b = rng.integers(0, n, 300), rng.integers(0, n, 300)
        assert Minimum(v)(a, b).tolist() == [v[min(i, j):max(i, j) + 1].min() for i, j in zip(a, b)]


def test_stretches_lose_no_run():
    w = np.array([9, 8, 7, *[1, 2, 3] * 4, 5, 6, *[4] * 6, 3, *[1, 2, 3] * 4])
    parts = list(stretches(w, 6))
    assert len(parts) < len(w) and all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in brute(w.tolist()))
    assert find_runs(w) == brute(w.tolist())


def test_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    got = [tuple(r) for r in periodic_runs(odd, change=contract_change).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{x}" for x in made(rng))) for i in range(400)] + [(401, None), (402, ""), (None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()}
    assert got == {d: expected(d, t) for d, t in rows} and sum(r[1] for r in got.values()) > 50


def test_very_long_text_and_texts(spark):
    body = "x " * 50_000 + "y z " * 30_000 + " ".join(map(str, range(20_000)))
    r = periodic_runs(spark.createDataFrame([(1, body)], "doc_id long, text string"), texts=True).first()
    assert [tuple(x) for x in r.runs] == [(0, 50_000, 1), (50_000, 60_000, 2)]
    assert r.collapsed == "x y z " + " ".join(map(str, range(20_000))) and r.exponent_milli == 30_000_000


def test_empty(empty):
    assert periodic_runs(empty).count() == 0
