import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.rules import LabelMeta, is_correct, is_sensitive
from corvane.operators import calibrate as C
from corvane.operators import decide as X
from corvane.operators import labels as L
from corvane.operators import metrics as M
from corvane.operators import retrieval as R

META = LabelMeta(unknown=0, safe_unknown=(0, 1), sensitive=(7, 8))


def preds(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(10), rng.randrange(10) if rng.random() < 0.3 else None, round(rng.random(), 3)) for i in range(n)]
    rows = [(i, g, g if p is None else p, c) for i, g, p, c in rows]
    df = spark.createDataFrame(rows, "id long, label int, pred int, conf double")
    df = df.withColumn("ok", is_correct(F.col("label"), F.col("pred"), META)).withColumn("sens", is_sensitive(F.col("pred"), META))
    return df, rows


def test_sweep_against_brute_force_and_monotone(spark):
    df, rows = preds(spark)
    got = {(r["tau"], r["tau_s"]): r for r in C.threshold_sweep(df, C.grid_points(tau=(0.3, 0.5, 0.9), tau_s=(0.4, 0.95))).collect()}
    for (tau, tau_s), r in got.items():
        acc = [(g, p) for _, g, p, c in rows if c >= (max(tau, tau_s) if p in (7, 8) else tau)]
        good = sum(p == g or (g == 0 and p in (0, 1)) for g, p in acc)
        assert r["accepted"] == len(acc) and abs(r["sel"] - good / len(acc)) < 1e-12
        assert r["fe"] == sum(p in (7, 8) and p != g for g, p in acc)
    assert got[(0.3, 0.4)]["cov"] >= got[(0.5, 0.4)]["cov"] >= got[(0.9, 0.4)]["cov"]


def test_confidence_on_the_threshold_is_accepted(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.7, True, False)], "id long, label int, pred int, conf double, ok boolean, sens boolean")
    assert C.threshold_sweep(df, C.grid_points(tau=(0.7,), tau_s=(0.9,))).first()["accepted"] == 1


def test_no_rule_point_gives_no_row(spark):
    df, _ = preds(spark)
    assert C.locked_rule(df, sel=1.01).count() == 0
    assert C.smallest_tau(df, [0.5], target=1.01).first()["tau"] == 0.99


def test_ties_prefer_lower_thresholds(spark):
    df = spark.createDataFrame([(i, 1, 1, 0.995, True, False) for i in range(10)], "id long, label int, pred int, conf double, ok boolean, sens boolean")
    r = C.locked_rule(df).first()
    assert (r["tau"], r["tau_s"]) == (0.5, 0.95)


def test_bands_with_few_negatives_lie_above_them(spark):
    df = spark.createDataFrame([(0.1 * i, i % 2 == 0) for i in range(10)], "s double, y boolean")
    b = C.quantile_bands(df, "s", F.col("y")).first()
    assert b["hi"] > 0.9 and b["lo"] == 0.0


def test_topic_vote_table(spark):
    rows = [(5, 3, 1.2, 0.1), (5, 3, 0.1, 0.1), (5, 3, 0.1, 0.3), (3, 3, 0.0, 0.0), (5, 2, 0.0, 0.0), (5, 3, 0.5, 0.3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, words int, user_turns int, bm25 double, cos double")
    got = [(r["vote"], r["escalate"]) for r in X.topic_vote(df).orderBy("i").collect()]
    assert got == [("same", False), ("new", False), ("same", True), ("same", False), ("same", False), ("same", False)]


def test_select_ties_keep_catalogue_order_and_empty_rows(spark):
    df = spark.createDataFrame(
        [(1, [0.2, 0.2, 0.0], [0.0, 0.0, 0.2], [0.0, 0.0, 0.0], [1]), (2, [0.1, 0.0, 0.0], [0.0] * 3, [0.0] * 3, [0])],
        "id long, bm25 array<double>, bigram array<double>, cos array<double>, gold array<int>")
    sel = {r["id"]: r["selected"] for r in R.fuse_max_select(df, 0.0, k=2).collect()}
    assert sel == {1: [0, 1], 2: []}
    m = R.micro_prf(R.fuse_max_select(df, 0.0, k=2)).first()
    assert (m["tp"], m["fp"], m["fn"], m["hit1"], m["empty"]) == (1, 1, 1, 0.0, 0.5)
    s = R.baseline_sweep(df, C.grid_points(wl=[1.0], wb=[1.0], base=[0.0]), k=2).first()
    assert (s["tp"], s["fp"], s["fn"], s["hit1"], s["empty"]) == (1, 1, 1, 0.0, 0.5)


def test_judges_of_the_same_family_are_found(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "id long, fam string, judge string")
    assert [r["id"] for r in L.same_family_violations(df, "fam", "judge").collect()] == [1]


def test_annotators_fall_back_and_failed_batches_stay_open(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(8)], "id long, text string").coalesce(1)

    def short(texts):
        return ["only one"]

    def picky(texts):
        if any(len(t) > 5 for t in texts):
            raise TimeoutError
        return [str(len(t)) for t in texts]

    got = {r["id"]: (r["label"], r["annotator"]) for r in L.annotate_batches(df, [short, picky], 3).collect()}
    assert got[0] == ("0", 1) and got[5] == ("5", 1) and got[6] == (None, None)


def test_agreement_report(spark):
    rows = [(1, "a", "x", 1, 1, "agree"), (2, "a", "x", 1, 1, "agree"), (3, "b", None, 2, 2, "agree"), (4, "b", "y", 2, 1, "disagree"),
            (5, "b", "y", 2, 1, "disagree"), (6, None, "y", 1, 3, "disagree"), (7, "a", "x", 1, None, "unjudged")]
    df = spark.createDataFrame(rows, "id long, gen string, kind string, gold int, judge_label int, status string")
    got = {(r.what, r.key): r.n for r in L.agreement_report(df, ["gen", "kind"], "gold", top=1).collect()}
    assert got == {("status", "agree"): 3, ("status", "disagree"): 3, ("status", "unjudged"): 1, ("agree", "a/x"): 2, ("agree", "b/?"): 1,
                   ("agree_gen", "a"): 2, ("agree_gen", "b"): 1, ("disagree_gen", "b"): 2, ("disagree_gen", "?"): 1, ("agree_kind", "x"): 2,
                   ("agree_kind", "?"): 1, ("disagree_kind", "y"): 3, ("label", "min"): 1, ("label", "max"): 2, ("disagreement", "2->1"): 2}
    assert L.agreement_report(df.limit(0), ["gen", "kind"], "gold").count() == 0


def test_own_family_is_refused_unless_overridden(spark):
    items = spark.createDataFrame([(1, "q"), (2, "z"), (3, None), (4, "q")], "id long, fam string")
    low = spark.createDataFrame([(1, 0, "q", 5), (2, 0, "q", 6)], "id long, pos long, judge string, label int")
    high = spark.createDataFrame([(1, 0, "c", 7)], low.schema)
    got = {r.id: (r.judge, r.label) for r in L.merge_judges_of(items, [low, high], "id", "label", "fam").collect()}
    assert got == {1: ("c", 7), 2: ("q", 6), 3: (None, None), 4: (None, None)}
    with pytest.raises(Exception, match="judged by its own family: 1"):
        L.merge_judges_of(items, [low], "id", "label", "fam").collect()


def test_choice_of_a_knn_rule(spark):
    cols = "c double, agree int, n long, primary double, accepted long, resc_prec double"
    base, good = (None, 0, 100, 0.80, 90, 1.0), (0.9, 0, 100, 0.82, 92, 0.98)
    pick = lambda *rows: tuple(X.choose_knn_rule(spark.createDataFrame(list(rows), cols)).first())
    assert pick(base) == base
    assert pick(base, (0.8, 0, 100, 0.9, 95, 0.97)) == base  # not precise
    assert pick(base, (0.8, 0, 100, 0.85, 100, 0.99)) == base  # costs accuracy of accepted rows
    assert pick(base, good, (0.88, 1, 100, 0.82, 92, 0.98)) == good  # tie: greatest c
    assert pick(base, good, (0.9, 1, 100, 0.82, 92, 0.98))[1] == 1  # then agreement


def test_shift_breakdown(spark):
    rows = [("en", "g", True, 0.9, False), ("en", "g", False, 0.1, False), ("zh", "h", True, 0.5, True), (None, "h", False, 0.5, False)]
    df = spark.createDataFrame(rows, "lang string, gen string, y boolean, jac double, cjk boolean")
    got = {(r.what, r.key): (r.n, r.value) for r in M.shift_breakdown(df, F.col("y"), "lang", "gen", "jac", F.col("cjk")).collect()}
    assert got == {("lang", "en"): (2, 0.5), ("lang", "zh"): (1, 1.0), ("lang", "?"): (1, 0.0), ("gen", "g"): (2, 0.5), ("gen", "h"): (2, 0.5),
                   ("auc", "all"): (4, 0.875), ("auc_lang", "en"): (2, 1.0), ("cjk", "none"): (3, 0.75)}


def test_temperature_by_batch_sums(spark):
    """Against a plain loop over a fine grid; rows of any number of logits, null rows and labels left out."""
    rng = random.Random(3)
    rows = [([rng.gauss(0, 3) for _ in range(rng.randrange(2, 6))], rng.randrange(2)) for _ in range(300)]
    odd = [(None, 1), ([1.0, None], 0), ([1.0, 2.0], None), ([], None)]
    df = spark.createDataFrame(rows + odd, "z array<double>, y int").repartition(3)

    def mean(t):
        return sum(-math.log(math.exp((z[y] - max(z)) / t) / sum(math.exp((x - max(z)) / t) for x in z) + 1e-12) for z, y in rows) / len(rows)

    got = C.fit_temperature(df, "z", F.col("y")).first()
    assert abs(got["nll"] - mean(got["t"])) < 1e-9
    assert got["nll"] <= min(mean(0.05 + 19.95 * i / 400) for i in range(401)) + 1e-6
    assert C.fit_temperature(df.limit(0), "z", F.col("y")).first()["nll"] is None
