"""Answers that must not depend on sizes, cuts or outliers."""

import random

import numpy as np

from corvane.functions.ranking import cumulate, ordinal, with_cell
from corvane.functions.text import norm_key_plain
from corvane.operators import retrieval as R
from corvane.operators import vectors as V


def vectors(spark, rows, extra="fold int"):
    return spark.createDataFrame(rows, f"id long, vec array<double>, {extra}")


def at_cosine(c):
    return [c, float(np.sqrt(1 - c * c))]


def test_near_ties_are_the_same_by_broadcast_and_by_blocks(spark):
    q = vectors(spark, [(1, [1.0, 0.0], 0)])
    ref = vectors(spark, [(10, at_cosine(0.9), 1), (20, at_cosine(0.9 + 2e-11), 1), (30, at_cosine(0.9 + 2e-14), 1), (40, at_cosine(0.5), 1)])
    out = [V.nearest(q, ref, **kw).collect() for kw in ({}, {"broadcast_bytes": 0, "block_rows": 1}, {"broadcast_bytes": 0, "block_rows": 3})]
    assert {(r.nn, round(r.max_cos, 13)) for rows in out for r in rows} == {(20, round(0.9 + 2e-11, 13))}


def test_a_table_meets_itself_in_blocks_as_by_broadcast(spark):
    """Both sides of one table, in blocks: the columns of the sides were taken for each other."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3, i % 4) for i in range(90)], "id long, vec array<double>, fold int, label int")
    gold = rows.selectExpr("id", "id + 1 gold_id")

    def answers(**kw):
        per = V.max_sim_per_label(rows, rows, skip_self=True, **kw)
        found = (V.nearest(rows, rows, skip_self=True, **kw), V.nearest(rows, rows, skip_same="fold", **kw), per, V.top1_gap(per),
                 V.pair_similarity(rows, rows, skip_self=True, **kw), V.rank_of_gold(rows.select("id", "vec"), rows, gold, **kw),
                 V.leak_guard(rows.filter("fold = 0"), rows.filter("fold > 0"), 0.9, **kw).select("id", "label"))
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in found]

    whole = answers()
    assert len(whole[0]) == 90 and len(whole[5]) == 89
    assert answers(broadcast_bytes=0, block_rows=20) == whole


def test_label_maxima_by_single_products_are_those_in_double(monkeypatch):
    """All products were made in double, in matrices beyond a core's cache."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[40:90] = m[40]  # copies
    m[90:120] = m[90] + 1e-9 * rng.normal(size=(30, 8))  # nearer to each other than single precision tells
    m[120], m[299, 2] = 0, np.nan
    x = V.pd.DataFrame({"id": rng.permutation(300), "label": np.sort(rng.integers(0, 4, 300))})
    x.loc[299, "label"], x.loc[0, "label"] = 5, -1  # alone in their labels
    x["by_id"] = np.argsort(x["id"].to_numpy(), kind="stable")
    u = V.over_norm(m)
    s = u @ u.T
    for skip_self in (True, False):
        want = s.copy()
        want[np.arange(300), np.arange(300)] = -1 if skip_self else s.diagonal()
        want = np.maximum.reduceat(want, np.unique(x["label"], return_index=True)[1], axis=1)
        for stretch in (7, 64, 2048):
            monkeypatch.setattr(V, "STRETCH", stretch)
            names, got = V._best_per_label((x, u), (x, u), skip_self)
            assert list(names) == [-1, 0, 1, 2, 3, 5] and np.allclose(got, want, rtol=0, atol=1e-14, equal_nan=True)


def test_no_eligible_reference_is_null(spark):
    rows = vectors(spark, [(1, [1.0, 0.0], 7), (2, [0.0, 0.0], 7), (3, None, 7)])
    for kw in ({"skip_same": "fold"}, {"mask_at": 0.0}):
        for cut in ({}, {"broadcast_bytes": 0, "block_rows": 1}):
            got = {r.id: (r.max_cos, r.nn) for r in V.nearest(rows, rows, **kw, **cut).collect()}
            assert got == {1: (None, None), 2: (None, None)}
    alone = V.nearest(rows.filter("id = 1"), rows.filter("id = 1"), skip_self=True).first()
    assert (alone.max_cos, alone.nn) == (None, None)


def test_zero_vectors_are_similar_to_nothing(spark):
    rows = vectors(spark, [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [-1.0, 0.0], 0)])
    got = {r.id: (r.max_cos, r.nn) for r in V.nearest(rows, rows, skip_self=True).collect()}
    assert got == {1: (0.0, 2), 2: (0.0, 1), 3: (0.0, 2)}


def test_an_outlier_takes_no_cell_from_the_others(spark):
    df = spark.range(4000).selectExpr("id", "if(id = 7, 1e300, cast(id as double) / 1e6) x")
    sizes = [r["count"] for r in with_cell(df, "x").groupBy("_cell").count().collect()]
    assert max(sizes) <= 2 * 4000 / len(sizes)
    got = [(r.id, r.rn) for r in ordinal(df, [], "x", ["id"]).collect()]
    want = {i: k + 1 for k, i in enumerate(sorted(range(4000), key=lambda i: (1e300 if i == 7 else i / 1e6, i)))}
    assert dict(got) == want
    sums = cumulate(df.selectExpr("x", "1 n"), [], "x", ["n"]).agg({"n_before": "max", "n_all": "max"}).first()
    assert sorted(sums) == [3999, 4000]


def test_three_thousand_candidates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    cat = [(f"c{i:04}", " ".join(rng.choices(words, k=12))) for i in range(3000)]
    tasks = [(i, "en", cat[i * 7][1] + " " + " ".join(rng.choices(words, k=20))) for i in range(40)] + [(99, "en", ""), (98, "en", "?!")]
    found = R.signals(spark.createDataFrame(tasks, "id long, lang string, text string"),
                      R.numbered(spark.createDataFrame(cat, "item_id string, text string"), "item_id"), norm_key_plain)
    rows = {r.id: r for r in found.collect()}
    assert found.columns == ["id", "lang", "bm25", "bigram", "gold", "cos"]
    for i in range(40):
        r = rows[i]
        assert len(r.bm25) == len(r.bigram) == len(r.cos) == 3000 and i * 7 in r.gold and abs(max(r.bm25) - 1) < 1e-12
        a, b = tasks[i][2].split(), cat[i * 7][1].split()
        dot = sum(a.count(w) * b.count(w) for w in set(b))
        size = lambda x: sum(x.count(w) ** 2 for w in set(x)) ** 0.5
        assert abs(r.cos[i * 7] - dot / size(a) / size(b)) < 1e-12
    assert max(rows[99].bm25) == 0 and max(rows[98].cos) == 0


def test_signals_need_no_shuffle(spark):
    docs = spark.range(10).selectExpr("id", "'en' lang", "'a b c' text")
    cat = R.numbered(spark.createDataFrame([("x", "a b")], "item_id string, text string"), "item_id")
    plan = R.signals(docs, cat, norm_key_plain)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_fit_does_not_depend_on_partitions_or_batches(spark, monkeypatch):
    from corvane.operators import models as M

    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 3), 0) for i in range(240)]
    df = M.training_rows(spark.createDataFrame(rows, "id long, vec array<double>, label int, fold int"), 3)
    recipe = M.Recipe("r", width=8, lr=0.05, dropout=0.3)
    monkeypatch.setattr(M, "CHUNK", 7)
    one, four, many = (M.train_grid(df.repartition(n, "id"), [recipe], 3, fan_in=3)[0] for n in (1, 4, 11))
    for other in (four, many):  # eleven parts are more than fan-in squared
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(M._parts(one), M._parts(other)))
    mask = M.dropout_mask(M.Recipe("r", width=64, dropout=0.3), 1, np.arange(4000), 64)
    assert abs((mask > 0).mean() - 0.7) < 0.01 and set(np.unique(mask)) == {0, 1 / 0.7}


def test_quantile_map_compares_the_vectors_once(spark):
    from corvane.plans import q_vectors

    plan = q_vectors.v12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # quantiles read stored scores
