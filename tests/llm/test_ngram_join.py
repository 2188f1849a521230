"""Operator 9 and the components against brute force."""

import random

import numpy as np
import pytest

from corvane.llm import ngram_join
from corvane.llm.components import components
from corvane.llm.ngram_join import ngram_components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    k = min(n, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * den >= len(sets[i] | sets[j]) * num:
                root[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted(((r.id, r.n_grams, r.component_id) for r in ngram_components(df, **kw).collect()), key=str)


def family(seed, size=120):
    """Texts that drift away from each other by a few words, so that links form chains."""
    rng = random.Random(seed)
    out = []
    for g in range(6):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(size // 6):
            if rng.random() < 0.8:
                words = list(words)
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return [(i * 7 + 3, t) for i, t in enumerate(out)]


def test_odd_rows(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 90, 100)


@pytest.mark.parametrize("n,num,den,small", [(3, 90, 100, False), (5, 80, 100, True), (2, 60, 100, True)])
def test_chains(spark, monkeypatch, n, num, den, small):
    rows = family(n) + [(None, "w1 w2 w3 w4"), (None, None), (1, ""), (2, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kw = {}
    if small:  # every bucket is dealt over salts and compared in blocks
        monkeypatch.setattr(ngram_join, "BLOCK", 3)
        kw = {"bits": 4, "max_bytes": 3000}

        init = ngram_join.Order.__init__

        def salted(self, *args):
            init(self, *args)
            self.salts = self.salts * 0 + 3

        monkeypatch.setattr(ngram_join.Order, "__init__", salted)
    assert got(df, n=n, num=num, den=den, **kw) == brute(rows, n, num, den)


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows, 3, 90, 100)


def test_overlaps_are_not_counted_for_equal_sets(spark, monkeypatch):
    """Copies in several partitions were fetched and compared like different texts."""
    texts = [" ".join(f"g{g}w{i}" for i in range(60)) for g in range(3)] + [" ".join(f"g0w{i}" for i in range(59)) + " other"]
    rows = [(g * 100 + i, t) for g, t in enumerate(texts) for i in range(8)]
    asked, count = [], ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda pairs, *args: asked.append(pairs.count()) or count(pairs, *args))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")) == brute(rows, 3, 90, 100)
    assert sum(asked) == 1  # the first copies of texts 0 and 3


@pytest.mark.parametrize("most", [1, 2, 64])
def test_rows_without_a_partner_leave_their_bucket(most):
    rng = np.random.default_rng(most)
    x = np.array(sorted([int(g), 0, 2 if g == 5 else 1, i, n := int(rng.integers(10, 60)), int(rng.integers(0, n // 10 + 1))]
                        for i, g in enumerate(rng.integers(0, 40, 300))))
    fits = {tuple(a) for a in x for b in x if a[0] == b[0] and a[3] != b[3] and min(a[4], b[4]) * 100 >= max(a[4], b[4]) * 90
            and min(a[4] - a[5], b[4] - b[5]) * 190 >= (a[4] + b[4]) * 90}
    stay = {tuple(a) for a in x if a[0] in (x[0, 0], x[-1, 0]) or a[2] > 1}
    kept = [tuple(a) for a in ngram_join._partnered(x, 90, 100, most)]
    assert kept == sorted(kept) and fits | stay <= set(kept) and (most < 64 or set(kept) == fits | stay) and len(kept) < 300


def test_empty(empty):
    assert ngram_components(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 20), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
