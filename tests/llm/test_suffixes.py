"""Operator 2 against all pairs of word windows."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from corvane.llm.suffixes import _neighbours, minimisers, repeated_passages, words_of


def brute(rows, least=50):
    """Words that lie in a window of `least` words which another row holds too, as merged stretches."""
    held, marks = defaultdict(set), []
    words = [words_of(t or "") for _, t in rows]
    for i, w in enumerate(words):
        for p in range(len(w) - least + 1):
            held[tuple(w[p:p + least])].add(i)
    out = []
    for i, w in enumerate(words):
        marks = [p for p in range(len(w) - least + 1) if held[tuple(w[p:p + least])] - {i}]
        spans = []
        for p in marks:
            if spans and spans[-1][1] >= p:
                spans[-1][1] = p + least
            else:
                spans.append([p, p + least])
        out += [(rows[i][0], a, b) for a, b in spans]
    return sorted(out, key=str)


def got(df, **kw):
    rows = repeated_passages(df, **kw).collect()
    assert all(r.n_words == r.stop_word - r.start_word for r in rows)
    return sorted(((r.id, r.start_word, r.stop_word) for r in rows), key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 200, 500)]
    rows = []
    for i in range(60):
        text = [f"y{i}-{k}" for k in range(rng.randrange(30))]
        for s in rng.sample(shared, 2):
            text += s + [f"x{i}-{len(text)}-{k}" for k in range(1 + rng.randrange(40))]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, seed):
    rows = passages(seed) + [(None, "a b c " * 40), (100, "A b  c\n" * 40), (101, None), (102, ""), (103, "short text"), (104, "z " * 5000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), max_bytes=20_000) == brute(rows)


def test_odd_rows(odd, docs):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    found, want = defaultdict(set), defaultdict(set)
    for out, rows in ((found, got(docs)), (want, brute([(r.doc_id, r.text) for r in docs.collect()]))):
        for i, a, b in rows:
            out[i] |= set(range(a, b))
    assert found.keys() == want.keys() and all(found[i] <= want[i] for i in want)
    # a stretch may lack end words that repeat by chance beside a passage, in a text that is not its neighbour
    assert sum(map(len, found.values())) >= 0.995 * sum(map(len, want.values()))


def test_hot_passage(spark):
    rng = random.Random(5)
    hot = " ".join(f"h{rng.randrange(1000)}" for _ in range(80))
    rows = [(i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) + (" " + hot if i % 3 == 0 else "")) for i in range(600)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)) == brute(rows)


def test_common_tails_and_doubled_passages(spark):
    """Passages whose last words also stand in many other texts under 50 words, and passages held twice."""
    rng = random.Random(9)
    own = lambda c, n: [f"{c}{rng.randrange(10**6)}" for _ in range(n)]
    rows, notice = [], own("n", 45)
    for head, tail in ((30, 25), (20, 35), (12, 45), (5, 45), (4, 45)):
        for _ in range(6):
            passage = own("p", head) + notice[:tail]
            rows += [own("a", 40) + passage + own("b", 40) for _ in range(2)]
    rows += [own("c", 60) + notice + own("d", 30) for _ in range(30)]
    for n in (50, 55, 120):
        passage = own("q", n)
        rows += [own("e", 9) + passage + own("f", 70) + passage + own("g", 5), own("h", 30) + passage + own("i", 30),
                 passage + own("j", 3) + passage, own("k", 20) + passage[:n // 2] + own("l", 60)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_equal_to_brute_force_on_documents(docs):
    """Words beside a passage that repeat in a third text belong to the stretch too."""
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(empty):
    assert repeated_passages(empty).count() == 0


def test_minimisers_depend_on_the_words_alone():
    rng = random.Random(2)
    p = [f"p{rng.randrange(50)}".encode() for _ in range(43)]
    a, b = ([f"{c}{i}".encode() for i in range(77)] + p + [f"{c}{i}".encode() for i in range(50)] for c in "ab")
    assert set(minimisers(a)[1].tolist()) & set(minimisers(b)[1].tolist())
    assert len(minimisers([b"a"] * 5000)[0]) < 200


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_over_batches_and_tasks(seed):
    """The nearest other text of every suffix, however the sorted rows are cut into tasks and batches."""
    rng = random.Random(seed)
    n, least, texts = 400, 12, rng.choice([1, 2, 5, 60])
    word = lambda: bytes([0, rng.randrange(2)])
    rows = sorted({(bytes([0, rng.randrange(2)]) + b"".join(word() for _ in range(rng.randrange(8, least + 1))), rng.randrange(texts), i) for i in range(n)})
    common = lambda a, b: next((k for k in range(min(len(a), len(b)) // 2) if a[2 * k:2 * k + 2] != b[2 * k:2 * k + 2]), min(len(a), len(b)) // 2)
    want = {c: max([common(s, t) - 1 for t, o, _ in rows if o != tag], default=-1) for s, tag, c in rows}

    def cut(part):
        while part:
            k = rng.randrange(1, 9)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in part[:k]], pa.int64()), pa.array([r[2] for r in part[:k]], pa.int64()),
                                              pa.array([r[0] for r in part[:k]], pa.binary())], names=["tag", "ctx", "suffix"])
            part = part[k:]

    ends = sorted(rng.sample(range(n), 9)) + [n]
    told = [r for i, j in zip([0, *ends], ends) for b in _neighbours(least, True)(cut(rows[i:j])) for r in b.to_pylist()]
    again = sorted((r["edge"], r["tag"], r["ctx"]) for r in told if r["edge"] is not None)
    told += [r for b in _neighbours(least, False)(cut(again)) for r in b.to_pylist()]
    got = dict.fromkeys(want, 0)
    for r in told:
        got[r["ctx"]] = max(got[r["ctx"]], r["length"])
    assert got.keys() == want.keys()
    assert all(got[c] == want[c] if want[c] >= 8 else got[c] < 8 for c in want)
