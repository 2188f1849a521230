"""Queries on embeddings: J6, J7, J9, D4, D6-D8, D11, V1-V15."""

from pyspark.sql import functions as F

from ..functions import vectors as VF
from ..functions.hashing import hash_int
from ..operators import dedup as D
from ..operators import vectors as V
from ..session import stored
from .base import query, sql_hint, table
from .q_sets import SQL_NGRAM, ngram_near

DIM = 64
E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
SIM = "list_cosine_similarity"
# every pair of different vectors
PAIRS = E_SQL + f", p AS (SELECT a.id, b.id AS rid, b.label, {SIM}(a.vec,b.vec) AS sim FROM e a JOIN e b ON a.id<>b.id)"
# unlabelled items against labelled ones
ROLES = E_SQL + f""", q AS (SELECT * FROM e WHERE id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT * FROM e WHERE id IN (SELECT doc_id FROM labels)),
 p AS (SELECT q.id, r.id AS rid, round({SIM}(q.vec,r.vec),12) AS sim FROM q, r),
 near AS (SELECT id, max(sim) AS max_cos, arg_min(rid,(-sim,rid)) AS nn FROM p GROUP BY id)"""
DUP_T = 0.38


def emb(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def roles(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    e = emb(spark, sf)
    return e.join(lab, "id", "left_anti"), e.join(lab, "id", "left_semi")


def r6(c):
    return F.round(c, 6).alias(c)


@query("j6_pair_similarity", f"WITH {PAIRS} SELECT id, count(*) AS n, round(avg(sim),6) AS mean, round(min(sim),6) AS lo, round(max(sim),6) AS hi FROM p GROUP BY id")
def j6(spark, sf):
    e = emb(spark, sf)
    return V.pair_similarity(e, e, skip_self=True).select("id", "n", r6("mean"), r6("lo"), r6("hi"))


@query("j7_max_sim_per_label", f"WITH {PAIRS} SELECT id, label, round(max(sim),6) AS sim FROM p GROUP BY ALL")
def j7(spark, sf):
    return label_scores(spark, sf).select("id", "label", r6("sim"))


def label_scores(spark, sf, dims=DIM):
    e = emb(spark, sf)
    if dims < DIM:
        e = e.withColumn("vec", F.slice("vec", 1, dims))
    return V.max_sim_per_label(e, e, skip_self=True)


CENT = """ce AS (SELECT label, list(m ORDER BY pos) AS cvec FROM (SELECT label, pos, avg(x) AS m FROM
 (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


@query("j9_candidate_join", f"WITH {E_SQL}, {CENT} SELECT e.id, ce.label AS cand, round({SIM}(e.vec,ce.cvec),6) AS cos FROM e, ce")
def j9(spark, sf):
    e = emb(spark, sf)
    scored, names = V.candidate_join(e.select("id", "vec"), V.centroids(e), "label")
    entries = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("cand"), F.col("cos").alias("cos"))
    return scored.select("id", F.explode(entries).alias("c")).select("id", "c.cand", F.round("c.cos", 6).alias("cos"))


@query("d4_near_dup_cosine", f"WITH {ROLES} SELECT id, round(max_cos,6) AS max_cos, nn, max_cos>{DUP_T} AS dropped FROM near")
def d4(spark, sf):
    q, r = roles(spark, sf)
    return V.near_dup_cosine(q, r, DUP_T).select("id", r6("max_cos"), "nn", "dropped")


@query("d6_near_dup_report", f"""WITH {ROLES}, {SQL_NGRAM}, c AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
 SELECT c.id, CASE WHEN max_cos>{DUP_T} THEN 'cos' WHEN max_jac>0.6 THEN 'jacc' ELSE 'kept' END AS reason,
 CASE WHEN max_cos>{DUP_T} THEN nn WHEN max_jac>0.6 THEN nn_jac END AS nearest FROM c LEFT JOIN near USING (id) LEFT JOIN nd USING (id)""")
def d6(spark, sf):
    q, r = roles(spark, sf)
    ids = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    cos = V.nearest(q, r).withColumnRenamed("nn", "nn_cos")
    return D.near_dup_report(ids.withColumnRenamed("doc_id", "id"), cos, ngram_near(spark, sf), DUP_T, 0.6).select("id", "reason", "nearest")


@query("d7_leak_guard", f"WITH {ROLES} SELECT q.id, q.label FROM q JOIN near USING (id) WHERE max_cos<={DUP_T}")
def d7(spark, sf):
    train, test = roles(spark, sf)
    return V.leak_guard(train, test, DUP_T).select("id", "label")


@query("d8_mask_self_matches", f"""WITH {E_SQL}, p AS (SELECT a.id, b.label, {SIM}(a.vec,b.vec) AS sim FROM e a, e b)
 SELECT id, label, round(max(CASE WHEN sim>=0.98 THEN -1 ELSE sim END),6) AS sim FROM p GROUP BY ALL""")
def d8(spark, sf):
    e = emb(spark, sf)
    return V.max_sim_per_label(e, e, mask_at=0.98).select("id", "label", r6("sim"))


@query("d11_similarity_percentiles", f"WITH {ROLES} SELECT round(quantile_cont(max_cos,0.5),6) AS p50, round(quantile_cont(max_cos,0.9),6) AS p90, round(quantile_cont(max_cos,0.99),6) AS p99 FROM near")
def d11(spark, sf):
    q, r = roles(spark, sf)
    return D.similarity_percentiles(V.nearest(q, r), "max_cos").select(r6("p50"), r6("p90"), r6("p99"))


@query("v1_l2_normalize", f"WITH {E_SQL}, s AS (SELECT id, vec, sqrt(list_dot_product(vec,vec)) AS n FROM e) SELECT id, round(vec[1]/n,6) AS first, round(list_sum(vec)/n,6) AS total FROM s")
def v1(spark, sf):
    v = VF.l2_normalize(F.col("vec"))
    return emb(spark, sf).select("id", v.alias("vec")).select("id", F.round(F.col("vec")[0], 6).alias("first"),
                                                              F.round(_total("vec"), 6).alias("total"))


def _total(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def neighbours(spark, sf):
    """Pairs (id, id + 1) with both vectors; related when the labels agree."""
    e = emb(spark, sf)
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("vec2"), F.col("label").alias("label2"))
    return e.join(nxt, "id").withColumn("related", F.col("label") == F.col("label2"))


NEXT = E_SQL + ", nb AS (SELECT a.id, a.vec, b.vec AS vec2, a.label=b.label AS related FROM e a JOIN e b ON b.id=a.id+1)"


@query("v2_cosine", f"WITH {NEXT} SELECT id, round({SIM}(vec,vec2),6) AS cos, round(list_dot_product(vec,vec2),6) AS dot FROM nb")
def v2(spark, sf):
    u, v = F.col("vec"), F.col("vec2")
    return neighbours(spark, sf).select("id", F.round(VF.cosine(u, v), 6).alias("cos"), F.round(VF.dot(u, v), 6).alias("dot"))


@query("v3_nearest", f"WITH {PAIRS} SELECT id, round(max(sim),6) AS max_cos, arg_min(rid,(-round(sim,12),rid)) AS nn FROM p GROUP BY id")
def v3(spark, sf):
    e = emb(spark, sf)
    return V.nearest(e, e, skip_self=True).select("id", r6("max_cos"), "nn")


SCORES = PAIRS + ", sc AS (SELECT id, label, max(sim) AS sim FROM p GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS k FROM sc)"
TOPGAP = SCORES + ", tg AS (SELECT id, max(label) FILTER (k=1) AS top_label, max(sim) FILTER (k=1) AS top, max(sim) FILTER (k=1)-max(sim) FILTER (k=2) AS gap FROM rk GROUP BY id)"


@query("v4_top1_gap", f"WITH {TOPGAP} SELECT id, top_label, round(top,6) AS top, round(gap,6) AS gap FROM tg")
def v4(spark, sf):
    return V.top1_gap(label_scores(spark, sf)).select("id", "top_label", r6("top"), r6("gap"))


@query("v5_knn_excluding_fold", f"""WITH {E_SQL}, f AS (SELECT *, {sql_hint("'f-'||id")}%5 AS fold FROM e), p AS (SELECT a.id, b.id AS rid, b.label, {SIM}(a.vec,b.vec) AS sim FROM f a JOIN f b ON a.fold<>b.fold)
 SELECT id, round(max(sim),6) AS max_cos, arg_min(rid,(-round(sim,12),rid)) AS nn FROM p GROUP BY id""")
def v5(spark, sf):
    f = emb(spark, sf).withColumn("fold", hash_int("f-", F.col("id")) % 5)
    return V.nearest(f, f, skip_same="fold").select("id", r6("max_cos"), "nn")


@query("v6_truncate_renorm", f"WITH {E_SQL}, s AS (SELECT id, vec[1:16] AS v FROM e) SELECT id, len(v)::INT AS dim, round(v[1]/sqrt(list_dot_product(v,v)),6) AS first, round(v[16]/sqrt(list_dot_product(v,v)),6) AS last FROM s")
def v6(spark, sf):
    v = emb(spark, sf).select("id", VF.truncate_renorm(F.col("vec"), 16).alias("v"))
    return v.select("id", F.size("v").alias("dim"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))


@query("v7_concat_vectors", f"WITH {E_SQL}, s AS (SELECT id, vec||vec[1:16] AS v FROM e) SELECT id, len(v)::INT AS dim, round(v[1],6) AS first, round(v[80],6) AS last FROM s")
def v7(spark, sf):
    e = emb(spark, sf).select("id", "vec")
    c = V.concat_vectors(e, e.withColumn("vec", F.slice("vec", 1, 16)))
    return c.select("id", F.size("vec").alias("dim"), F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[79], 6).alias("last"))


SQL_DP = "list_transform(list_zip(vec,vec2), lambda x: abs(x[1]-x[2]))||list_transform(list_zip(vec,vec2), lambda x: x[1]*x[2])||[list_dot_product(vec,vec2)]"


@query("v8_pair_features", f"WITH {NEXT}, f AS (SELECT id, vec||vec2||{SQL_DP} AS f, {SQL_DP} AS dp FROM nb) SELECT id, len(f)::INT AS dim, round(list_sum(f),6) AS total, len(dp)::INT AS dp_dim, round(list_sum(dp),6) AS dp_total FROM f")
def v8(spark, sf):
    u, v = F.col("vec"), F.col("vec2")
    f = neighbours(spark, sf).select("id", VF.pair_features(u, v, "full").alias("f"), VF.pair_features(u, v, "dp").alias("dp"))
    return f.select("id", F.size("f").alias("dim"), F.round(_total("f"), 6).alias("total"),
                    F.size("dp").alias("dp_dim"), F.round(_total("dp"), 6).alias("dp_total"))


@query("v9_standardize", f"""WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS pos FROM embeddings),
 s AS (SELECT pos, avg(x) AS m, stddev_pop(x)+1e-6 AS sd FROM x GROUP BY pos)
 SELECT id, round(max((x-m)/sd) FILTER (pos=1),6) AS first, round(sum((x-m)/sd),5) AS total FROM x JOIN s USING (pos) GROUP BY id""")
def v9(spark, sf):
    e = emb(spark, sf).select("id", "vec")
    out = V.apply_standardize(e, V.fit_standardize(e))
    return out.select("id", F.round(F.col("vec")[0], 6).alias("first"), F.round(_total("vec"), 5).alias("total"))


@query("v10_anchor_features", f"WITH {SCORES} SELECT id, count(*)::INT AS dim, round(max(sim) FILTER (label=0),6) AS first, round(max(sim) FILTER (label=9),6) AS last FROM sc GROUP BY id")
def v10(spark, sf):
    f = V.anchor_features(label_scores(spark, sf))
    return f.select("id", F.size("features").alias("dim"), F.round(F.col("features")[0], 6).alias("first"), F.round(F.col("features")[9], 6).alias("last"))


VARIANTS = {"full": 64, "half": 32, "quarter": 16}
VARIANT_SETS = {"full": ["full"], "full+half": ["full", "half"], "all": ["full", "half", "quarter"]}
SQL_VSETS = "vs(name, variant) AS (VALUES " + ",".join(f"('{s}','{v}')" for s, vs in VARIANT_SETS.items() for v in vs) + ")"


@query("v11_variant_mean_cosine", f"""WITH {E_SQL}, {CENT}, v(variant,d) AS (VALUES {",".join(f"('{k}',{d})" for k, d in VARIANTS.items())}), {SQL_VSETS},
 s AS (SELECT e.id, e.label AS gold, ce.label AS cand, variant, {SIM}(e.vec[1:d],ce.cvec[1:d]) AS c FROM e, ce, v),
 m AS (SELECT name, id, gold, cand, avg(c) AS c FROM s JOIN vs USING (variant) GROUP BY ALL),
 g AS (SELECT a.name, a.id, max(CASE WHEN a.cand=a.gold THEN a.c END) AS gc FROM m a GROUP BY ALL),
 r AS (SELECT m.name, m.id, 1+count_if(m.c>g.gc+1e-12) AS rank FROM m JOIN g USING (name,id) GROUP BY ALL)
 SELECT name AS variant_set, count(*) AS n, round(avg((rank=1)::INT),6) AS hit1, round(avg(1/rank),6) AS mrr FROM r GROUP BY name""")
def v11(spark, sf):
    e = emb(spark, sf)
    names, m = V.catalogue_matrix(V.centroids(e), "label")
    for name, d in VARIANTS.items():
        e = e.withColumn(f"c_{name}", V.cosines_to(m[:, :d])(F.slice("vec", 1, d)))
    sets = F.array(*[F.struct(F.lit(s).alias("name"), V.variant_mean([f"c_{x}" for x in vs]).alias("c")) for s, vs in VARIANT_SETS.items()])
    rows = e.select("label", F.explode(sets).alias("s")).select("s.name", "s.c", F.col("s.c")[F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")).cast("int") - 1].alias("gc"))
    rank = 1 + F.size(F.filter("c", lambda x: x > F.col("gc") + 1e-12))
    return rows.withColumn("rank", rank).groupBy(F.col("name").alias("variant_set")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("hit1"),
        F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


QUANTILES = [round(0.05 * i, 2) for i in range(1, 20)]


def _top5(scores):
    arr = F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, 5)
    return scores.groupBy("id").agg(arr.alias("t")).select(F.explode("t").alias("s"))


def _sql_top5(d, name):
    return f"""{name} AS (SELECT sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS k FROM
 (SELECT a.id, b.label, max({SIM}(a.vec[1:{d}],b.vec[1:{d}])) AS sim FROM e a JOIN e b ON a.id<>b.id GROUP BY ALL)) WHERE k<=5)"""


@query("v12_quantile_map", f"""WITH {E_SQL}, {_sql_top5(64, 'ta')}, {_sql_top5(32, 'tb')}, q AS (SELECT unnest((SELECT quantile_cont(sim,{QUANTILES!r}::DOUBLE[]) FROM ta)) AS a,
 unnest((SELECT quantile_cont(sim,{QUANTILES!r}::DOUBLE[]) FROM tb)) AS b) SELECT round(regr_slope(a,b),6) AS slope, round(regr_intercept(a,b),6) AS shift FROM q""")
def v12(spark, sf):
    # quantiles read their scores several times, and these cost a comparison of all pairs
    a, b = stored(_top5(label_scores(spark, sf)), "scores"), stored(_top5(label_scores(spark, sf, 32)), "scores")
    return V.quantile_map(a, b, "s", QUANTILES).select(r6("slope"), r6("shift"))


MAPS = [("keep", 1.0, 0.0), ("narrow", 0.5, 0.25), ("shift", 1.0, -0.1)]


@query("v13_affine_rescale", f"WITH {NEXT}, m(map,a,b) AS (VALUES {','.join(str(m) for m in MAPS)}) SELECT id, map, round(a*{SIM}(vec,vec2)+b,6) AS score FROM nb, m")
def v13(spark, sf):
    maps = F.explode(F.array(*[F.struct(F.lit(n).alias("map"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in MAPS]))
    s = neighbours(spark, sf).select("id", VF.cosine(F.col("vec"), F.col("vec2")).alias("s"))
    return s.select("id", "s", maps.alias("m")).select("id", "m.map", F.round(F.col("m.a") * F.col("s") + F.col("m.b"), 6).alias("score"))


@query("v14_vector_drift", f"""WITH {E_SQL}, d AS (SELECT {SIM}(vec, list_transform(vec, lambda x: floor(x*50)/50)) AS cos FROM e)
 SELECT count(*) AS n, round(avg(cos),6) AS mean, round(min(cos),6) AS lo, round(quantile_cont(cos,0.01),6) AS p01, round(quantile_cont(cos,0.05),6) AS p05,
 round(median(cos),6) AS median, count_if(cos<0.999)::BIGINT AS below_999, count_if(cos<0.9995)::BIGINT AS below_9995 FROM d""")
def v14(spark, sf):
    e = emb(spark, sf).select("id", "vec")
    coarse = e.withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * 50) / 50))
    s = V.drift_summary(V.vector_drift(e, coarse))
    return s.select("n", r6("mean"), r6("lo"), r6("p01"), r6("p05"), r6("median"), "below_999", "below_9995")


@query("v15_rank_of_gold", f"""WITH {E_SQL}, g AS (SELECT a.id, b.id AS gid, a.vec, {SIM}(a.vec,b.vec) AS gs FROM e a JOIN e b ON b.id=a.id+1)
 SELECT g.id, 1+count_if({SIM}(g.vec,e.vec)>gs+1e-12 AND e.id<>gid)::BIGINT AS rank FROM g JOIN e ON e.id<>g.id GROUP BY g.id""")
def v15(spark, sf):
    e = emb(spark, sf)
    gold = e.select("id", (F.col("id") + 1).alias("gold_id"))
    return V.rank_of_gold(e.select("id", "vec"), e, gold)
