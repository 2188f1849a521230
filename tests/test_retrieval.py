"""A catalogue in many blocks gives what one block gives, and what plain Python gives."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from corvane.functions.text import norm_key_plain
from corvane.operators import calibrate as C
from corvane.operators import retrieval as R
from oracle import compare, duck

SF = "/root/testdata/sf0.01"
RNG = random.Random(4)
WORDS = [f"w{i}" for i in range(40)]
CAT = [(f"c{i:03}", " ".join(RNG.choices(WORDS, k=RNG.randint(1, 9)))) for i in range(60)] + [("c900", ""), ("c901", "w1 w2"), ("c902", "w1 w2")]
TASKS = [(i, "en" if i % 2 else None, " ".join(RNG.choices(WORDS, k=15)) + " " + CAT[i % 61][1] * (i % 3 > 0)) for i in range(50)]
TASKS += [(98, "en", ""), (99, "de", "unknown words only"), (97, "de", "w1 w2")]
CUTS = [{"block_rows": 7}, {"block_rows": 7, "broadcast_bytes": 0}, {"block_rows": 63, "broadcast_bytes": 0}]


bm, cos = (lambda b, g, c: b), (lambda b, g, c: c)  # by value: workers do not import this module


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(TASKS, "id long, lang string, text string").repartition(3),
            R.numbered(spark.createDataFrame(CAT, "item_id string, text string").repartition(5), "item_id"))


def plain():
    """Signals by the formulas, per task and candidate in the order of the names."""
    cand = [Counter(t.split()) for _, t in sorted(CAT)]
    lengths = [sum(c.values()) for c in cand]
    mean = sum(lengths) / sum(n > 0 for n in lengths)
    df = Counter(w for c in cand for w in c)
    out = {}
    for i, _, text in TASKS:
        mine = Counter(text.split())
        rows = []
        for c, n in zip(cand, lengths):
            w = sum(math.log((len(cand) - df[x] + 0.5) / (df[x] + 0.5) + 1) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * n / mean)) for x in mine if x in c)
            size = math.sqrt(sum(v * v for v in mine.values()) * sum(v * v for v in c.values()))
            rows.append((w, sum(mine[x] * c[x] for x in mine) / size if size else 0.0))
        out[i] = rows
    return out


def rounded(rows):
    def cut(v):
        return round(v, 9) if isinstance(v, float) else [cut(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted((cut(tuple(r)) for r in rows), key=str)


def test_numbering_follows_the_names(tables):
    assert [(r.item_id, r.pos) for r in tables[1].orderBy("pos").collect()] == [(n, i) for i, (n, _) in enumerate(sorted(CAT))]


def test_pairs_equal_the_formulas(spark, tables):
    want = plain()
    for cut in ({}, *CUTS):
        index = R.index_catalogue(tables[1], norm_key_plain, cut.get("block_rows"))
        sizes = {k: v for k, v in cut.items() if k == "broadcast_bytes"}
        got = {(r.id, r.pos): (r.bm25, r.cos) for r in R.pair_scores(tables[0], index, **sizes).collect()}
        assert got.keys() == {(i, p) for i, rows in want.items() for p, r in enumerate(rows) if r[0] > 0}
        assert all(abs(v[k] - want[i][p][k]) < 1e-9 for (i, p), v in got.items() for k in (0, 1))
        assert index.n_blocks == -(-len(CAT) // (cut.get("block_rows") or len(CAT)))


def everything(tables, cut):
    sizes = {k: v for k, v in cut.items() if k == "broadcast_bytes"}
    tasks, cat = tables
    index = R.index_catalogue(cat, norm_key_plain, cut.get("block_rows"))
    grid = C.grid_points(wl=[0.6, 1.0], wb=[1.0], base=[0.0, 0.2, 0.9])
    profiles = R.profiles(tasks, index, **sizes).collect()
    return [rounded([(*r[:-1], sorted(map(tuple, r.known))) for r in profiles]),
            rounded(R.gold_places(tasks, index, {"a": bm, "b": cos, "c": R.fused_score(1, 1, 0.1)}, **sizes).collect()),
            rounded(R.best_candidates(tasks, index, {"x": (bm, 5, None), "y": (R.fused_score(0.6, 1, 0.2), 3, 0.3)},
                                      scope=lambda b, g, c: g >= 0.2, **sizes).collect()),
            rounded(R.fusion_sweep(tasks, index, grid, **sizes).select("wl", "wb", "base", "n", "tp", "fp", "fn", "hit1", "empty", "f1").collect()),
            rounded(R.signals(tasks, cat, norm_key_plain, **cut).collect())]


def test_blocks_change_nothing(spark, tables):
    one = everything(tables, {})
    assert len(one[1]) == len(TASKS) and sum(r[2] is not None for r in one[1]) > 20
    for cut in CUTS:
        assert everything(tables, cut) == one, cut


def test_sweep_equals_selection(spark, tables):
    index = R.index_catalogue(tables[1], norm_key_plain, 7)
    lists = R.best_candidates(tables[0], index, {"s": (R.fused_score(0.6, 1, 0.2), 5, 0.15)})
    a = R.prf_of_lists(lists, "s").first()
    b = R.fusion_sweep(tables[0], index, C.grid_points(wl=[0.6], wb=[1.0], base=[0.2])).first()
    assert all(abs(a[c] - b[c]) < 1e-12 for c in ("n", "tp", "fp", "fn", "hit1", "empty", "f1"))


def test_nothing_of_the_catalogue_reaches_the_driver(spark, tables, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self, *a, **k):
        raise AssertionError("collected")

    def one_row(self, collect=DataFrame.collect):
        rows = collect(self)
        assert len(rows) <= 1
        return rows

    monkeypatch.setattr(DataFrame, "collect", one_row)
    for name in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, refuse)
    index = R.index_catalogue(R.numbered(spark.createDataFrame(CAT, "item_id string, text string"), "item_id"), norm_key_plain, 7)
    places = R.gold_places(tables[0], index, {"a": bm}, broadcast_bytes=0)
    monkeypatch.undo()
    assert places.count() == len(TASKS)


def test_empty_catalogue_and_tasks(spark, tables):
    none = R.index_catalogue(R.numbered(spark.createDataFrame([], "item_id string, text string"), "item_id"), norm_key_plain)
    rows = R.best_candidates(tables[0], none, {"x": (bm, 5, None)}).collect()
    assert len(rows) == len(TASKS) and all(r.x == [] and r.n_gold == 0 for r in rows)
    assert R.gold_places(tables[0].limit(0), R.index_catalogue(tables[1], norm_key_plain, 7), {"a": bm}).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n[0] == "r" and n[1].isdigit()])
def test_at_a_larger_scale(spark, name):
    ok, note = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_tasks_are_scored_in_small_pieces(spark, monkeypatch):
    """However narrow the catalogue, so many tasks at once at most; the answer is that of one piece."""
    cat = spark.createDataFrame([("a", "red fox runs"), ("b", "blue whale sings"), ("c", "")], "name string, text string")
    tasks = spark.createDataFrame([(i, f"the red fox runs {i}" if i % 2 else "blue whale sings") for i in range(60)], "id long, text string").coalesce(1)
    index = R.index_catalogue(R.numbered(cat, "name").withColumnRenamed("name", "item_id"), norm_key_plain)
    answers = {}
    for n in (7, 1000):
        monkeypatch.setattr(R, "PIECE", n)
        sizes = R.score_blocks(tasks, index, lambda part, s: [part["id"], [part.num_rows] * part.num_rows], "id long, n int").agg({"n": "max"}).first()[0]
        assert sizes <= n
        answers[n] = sorted((r.id, round(r.best, 9), len(r.known)) for r in R.profiles(tasks, index).collect())
    assert answers[7] == answers[1000] and answers[7][0][2] == 2


def test_counts_over_a_threshold_are_those_of_the_scores():
    from time import perf_counter

    rng = np.random.default_rng(5)
    bm, bi, cos = (np.where(rng.random((200, 200)) < 0.3, np.round(rng.random((200, 200)), 2), 0) for _ in range(3))
    for points, thr in [(np.array([[a, b, c / 100] for a in (0.6, 0.8, 1.0, 1.2) for b in (0.6, 0.8, 1.0, 1.2) for c in range(0, 80, 2)]), 0.15),
                        (np.array([[0.7, 1.0, 0.3], [0.2, 0.0, -0.15], [0.7, 1.0, 0.1]]), 0.15), (np.array([[0.5, 0.5, 0.2]]), 0.0)]:
        start = perf_counter()
        want = np.stack([(R.fused_score(*p)(bm, bi, cos) >= thr).sum(1) for p in points], 1)
        plain = perf_counter() - start
        start = perf_counter()
        got = R.Reached(points, thr)(bm, bi, cos)
        fast = perf_counter() - start
        assert (got == want).all()
        assert len(points) < 100 or fast * 2 < plain


def test_places_are_looked_for_in_tasks_with_gold_only():
    class S:
        first, n, bm25, bigram, cos = 0, 3, np.ones((4, 3)), np.array([[0.0, 0, 0], [1, 2, 1], [0, 0, 0], [0, 0, 0]]), np.zeros((4, 3))
        gold_row, gold_at = np.array([1, 1]), np.array([0, 2])

    class Part:
        class schema:
            names = ()

    seen = []

    def score(bm, bi, cos):
        seen.append(np.shape(bi))
        return bi

    assert R.Known(Part, S).ahead(score).tolist() == [1, 2]
    assert seen == [(2,), (1, 3)]


def test_character_pairs_are_the_packed_grams(spark):
    from pyspark.sql import functions as F

    from corvane.functions.text import packed_ngrams

    texts = ["abcabc", "", "x", None, "\U0001f600\U0001f600b", "é\nß", "aa", "日本語 日本", "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    want = [r[0] and sorted(r[0]) for r in df.select(packed_ngrams(F.lower("s"), 2)).collect()]
    got = R._char_pairs(pa.array([t and t.lower() for t in texts])).to_pylist()
    assert got == [w or [] for w in want]


def test_no_expression_makes_the_pairs_of_the_tasks(spark):
    tasks = spark.createDataFrame([(1, "en", "w1 w2")], "id long, lang string, text string")
    index = R.index_catalogue(R.numbered(spark.createDataFrame(CAT, "name string, text string"), "name"), norm_key_plain)
    assert "regexp_extract_all" not in R.profiles(tasks, index)._jdf.queryExecution().optimizedPlan().toString()
