"""Queries M1, M3, M4, M7-M13, M15: heads applied and fitted."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.vectors import pair_features, truncate_renorm
from ..operators import metrics as E
from ..operators import models as M
from ..operators import vectors as V
from .base import LABELS, META, query, table
from .q_text import tools as tool_map
from .q_vectors import CENT, E_SQL, NEXT, SIM, emb, neighbours

K = len(LABELS)


def centroid_head(spark, sf) -> M.Head:
    """Hidden units are the label means; the output doubles each and adds a tenth of their sum."""
    _, c = V.catalogue_matrix(V.centroids(emb(spark, sf)), "label")
    return M.Head(c.T, np.full(K, 0.05), 2 * np.eye(K) + 0.1, np.zeros(K))


SQL_HEAD = f"""{E_SQL}, {CENT}, hd AS (SELECT e.id, ce.label AS l, greatest(0,list_dot_product(e.vec,ce.cvec)+0.05::DOUBLE) AS h FROM e, ce),
 lg AS (SELECT id, l AS label, 2*h+0.1::DOUBLE*sum(h) OVER (PARTITION BY id) AS z FROM hd)"""


@query("m1_mlp_score", f"WITH {SQL_HEAD} SELECT id, label, round(z,6) AS z FROM lg")
def m1(spark, sf):
    z = M.mlp_score(emb(spark, sf).select("id", "vec"), centroid_head(spark, sf))
    return z.select("id", F.posexplode("z").alias("label", "z")).select("id", "label", F.round("z", 6).alias("z"))


NAMES = [f"tool{i}" for i in range(K)]


@query("m3_ovr_score", f"""WITH {E_SQL}, {CENT}, s AS (SELECT e.id, ce.label AS i, CASE WHEN ce.label=9 THEN 0 ELSE 1/(1+exp(-(4*list_dot_product(e.vec,ce.cvec)-0.5::DOUBLE))) END AS p FROM e, ce),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i) AS k FROM s) SELECT e.id, coalesce(string_agg('tool'||i, ',' ORDER BY k.k),'') AS tools FROM e LEFT JOIN k ON k.id=e.id AND k.k<=5 AND p>=0.4::DOUBLE GROUP BY e.id""")
def m3(spark, sf):
    _, c = V.catalogue_matrix(V.centroids(emb(spark, sf)), "label")
    out = M.ovr_score(emb(spark, sf).select("id", "vec"), M.Head(4 * c.T, np.full(K, -0.5)), NAMES, {"tool9"}, theta=0.4, k=5)
    return out.select("id", F.array_join("tools", ",").alias("tools"))


PAIR_W = [((i * 7) % 11 - 5) / 10 for i in range(129)]


@query("m4_pair_score", f"WITH {NEXT}, f AS (SELECT id, list_transform(list_zip(vec,vec2), lambda x: abs(x[1]-x[2]))||list_transform(list_zip(vec,vec2), lambda x: x[1]*x[2])||[list_dot_product(vec,vec2)] AS f FROM nb) SELECT id, round(1/(1+exp(-(list_dot_product(f,{PAIR_W!r}::DOUBLE[])+0.1))),6) AS score FROM f")
def m4(spark, sf):
    return M.pair_score(neighbours(spark, sf), "vec", "vec2", "dp", PAIR_W, 0.1).select("id", F.round("score", 6).alias("score"))


def folded(spark, sf, k=3):
    return M.training_rows(emb(spark, sf).withColumn("fold", (hash_int("mf-", F.col("id")) % k).cast("int")), K)


# Fixed values of the recipes: 512 hidden units, batches of 200, 200 passes, step 1e-3 (the defaults of Recipe).
PLAIN = M.Recipe("plain")
FULL = M.Recipe("full", smoothing=0.05, sens_penalty=0.5, sensitive=META.sensitive, dropout=0.3)


@query("m7_train_logreg")
def m7(spark, sf):
    e = emb(spark, sf).select("id", "vec", "label")
    z = M.softmax_t(M.mlp_score(e, M.train_logreg(e)), "z", 1.0)
    return z.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))


@query("m8_train_ovr_balanced")
def m8(spark, sf):
    names = sorted({r["tool"] for r in tool_map(spark).select("tool").distinct().collect()}) + ["tool_unused"]
    gold = emb(spark, sf).join(F.broadcast(tool_map(spark)), "label").groupBy("id").agg(F.collect_set("tool").alias("gold"))
    rows = emb(spark, sf).select("id", "vec").join(gold, "id")
    head = M.train_ovr_balanced(rows, names, 200)
    probs = M.mlp_score(rows, head).select("gold", F.posexplode("z").alias("i", "z"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    p = probs.select(name.alias("tool"), F.array_contains("gold", name).alias("needed"), (1 / (1 + F.exp(-F.col("z")))).alias("p"))
    return p.groupBy("tool", "needed").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


def pair_rows(spark, sf, blocks="dp"):
    """Neighbour pairs with pair features, folds by the left vector's label."""
    p = neighbours(spark, sf).select("id", "label", pair_features(F.col("vec"), F.col("vec2"), blocks).alias("vec"), "related")
    return p.select("id", "vec", F.array(F.col("related").cast("double")).alias("target"), F.array(F.lit(1.0)).alias("weight"),
                    (F.col("label") % 3).alias("fold"))


@query("m9_train_pair_logistic")
def m9(spark, sf):
    rows = pair_rows(spark, sf)
    per, head = M.choose_logistic(rows, [10.0, 100.0, 1000.0], 3)
    z = M.mlp_score(rows.select("id", "vec", (F.col("target")[0] == 1).alias("y")), head)
    fitted = E.auc(z.select("y", F.col("z")[0].alias("s")), "s", F.col("y"), []).select("auc").scalar()
    best = per.agg(F.max(F.struct("auc", (-F.col("lam")).alias("neg")))).scalar()
    return per.withColumn("chosen", F.struct("auc", (-F.col("lam")).alias("neg")) == best).withColumn("fitted_auc", F.when(F.col("chosen"), fitted))


def accuracy(rows, head):
    z = M.softmax_t(M.mlp_score(rows, head), "z", 1.0)
    return z.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))


@query("m10_train_mlp_head")
def m10(spark, sf):
    rows = folded(spark, sf)
    one, two = M.train_batches(rows, [FULL, replace(FULL, depth=2)])
    return accuracy(rows, one).withColumn("depth", F.lit(1)).unionByName(accuracy(rows, two).withColumn("depth", F.lit(2)))


@query("m11_fit_grid")
def m11(spark, sf):
    z = M.fit_grid(folded(spark, sf), [PLAIN, FULL], 3)
    return z.groupBy("recipe", "seed", "fold").agg(F.count("*").alias("n"), F.avg(F.array_max("z")).alias("mean_top"))


# Fixed values of the pair head: 64 hidden units, batches of 128, 60 passes, a fifth of inputs and units dropped.
PAIR = M.Recipe("mlp", width=64, loss="sigmoid", batch=128, epochs=60, dropout=0.2, input_dropout=0.2, l2=0.0, decay=1e-2, standardise=True)


@query("m12_train_pair_mlp")
def m12(spark, sf):
    per = M.cv_auc(pair_rows(spark, sf), [replace(PAIR, seed=s) for s in (0, 1)], 3).groupBy("recipe", "seed").agg(F.avg("auc").alias("auc"))
    return E.mean_sd_over_seeds(per, "auc", ["recipe"])


@query("m13_oof_table")
def m13(spark, sf):
    rows = folded(spark, sf)
    return M.oof_table(M.fit_grid(rows, [PLAIN], 3), rows)


@query("m15_pair_variant_scan", f"""WITH {NEXT}, d AS (SELECT a, b, related AS y, {SIM}(CASE a WHEN 'head' THEN vec[1:32] ELSE vec[33:64] END, CASE b WHEN 'head' THEN vec2[1:32] ELSE vec2[33:64] END) AS s FROM nb, (VALUES ('head'),('tail')) x(a), (VALUES ('head'),('tail')) z(b)),
 c AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY s)+(count(*) OVER (PARTITION BY a, b, s)-1)/2 AS rk FROM d)
 SELECT a AS u, b AS v, count_if(y)::BIGINT AS n_pos, count_if(NOT y)::BIGINT AS n_neg, round((sum(rk) FILTER (y)-count_if(y)*(count_if(y)+1)/2)/(count_if(y)*count_if(NOT y)),6) AS auc FROM c GROUP BY ALL""")
def m15(spark, sf):
    def cuts(c):
        return {"head": F.slice(c, 1, 32), "tail": F.slice(c, 33, 32)}

    out = M.pair_variant_scan(neighbours(spark, sf), cuts("vec"), cuts("vec2"), F.col("related"))
    return out.select("u", "v", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))
