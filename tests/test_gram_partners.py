"""The best partner of a query set through several blocks, with few columns, bits and a rest."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import packed_ngrams
from corvane.operators import dedup as D


def block(sets, ids):
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.array(ids), sizes, np.repeat(np.arange(len(sets)), sizes), pa.array(np.concatenate([np.sort(s) for s in sets]))


def some(rng, n):
    """Sets of three families with different grams, near copies among them."""
    out = []
    for _ in range(n):
        base = rng.integers(0, 3) * 150
        s = set((base + rng.choice(200, rng.integers(60, 130), replace=False)).tolist())
        if out and rng.random() < 0.4:
            s = set(out[rng.integers(0, len(out))])
            for _ in range(rng.integers(0, 30)):
                s ^= {int(rng.integers(0, 500))}
        out.append(s)
    return [np.array(sorted(s)) for s in out]


@pytest.mark.parametrize("many", [-1, 2])
@pytest.mark.parametrize("bits", [64, 1 << 15])
def test_best_partners_of_many_blocks_equal_brute_force(monkeypatch, bits, many):
    for name, value in dict(COLUMNS=40, FEW=16, EXTRA=64, BITS=64 + bits, PART=16, PAIRS=7, MANY=many).items():
        monkeypatch.setattr(D, name, value)
    sets = some(np.random.default_rng(4), 260)
    q, r = sets[:80], sets[80:] + sets[200:]  # some reference sets stand twice, with greater ids
    ids = [7 * i % 1009 for i in range(len(r))]
    blocks = [block(r[i:i + 50], ids[i:i + 50]) for i in range(0, len(r), 50)]
    got = D._best_partners(block(q, range(5000, 5080)), iter(blocks), 0.6)
    want = {}
    for i, a in enumerate(q):
        tried = [(len(x := set(a) & set(b)) / (len(a) + len(b) - len(x)), -k) for k, b in zip(ids, r)]
        if (best := max(tried))[0] > 0.6:
            want[5000 + i] = (best[0], -best[1])
    assert 20 < len(want) < 80
    assert {a: (b, c) for a, b, c in zip(*(got[k].to_pylist() for k in ("q_rep", "jac", "r_rep")))} == want


def test_sets_made_in_arrow_are_those_of_the_column_function(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "\U0001f600b\U0001f601cd", "ﬁé中文字"]
    want = [sorted(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "s string").select(packed_ngrams(F.col("s"), 3)).collect()]
    assert D._packed(pa.array(texts), 3).to_pylist() == want
