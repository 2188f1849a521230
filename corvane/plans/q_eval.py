"""Queries J8, C*, X*, E* and M2, M5, M6, M14: scores, thresholds, replays, metrics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_unit
from ..functions.once import once
from ..functions.rules import accept, is_correct, is_sensitive, to_bands
from ..functions.text import char_ngrams, jaccard, tokens
from ..functions.vectors import softmax
from ..operators import calibrate as C
from ..operators import decide as X
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import splits as SP
from ..operators import vectors as V
from .base import (LABELS, META, PREDS, RUN2, RUNS, preds, query, runs, second_run, sql_hint, sql_hunit, sql_ok,
                   sql_sens, table)
from .q_sets import sql_rank
from .q_text import sql_grams
from .q_vectors import E_SQL, SIM, TOPGAP, emb, label_scores


def r9(*cols):
    return [F.round(c, 9).alias(c) for c in cols]


# --- derived inputs ------------------------------------------------------------------------
RECIPES, SEEDS, T_FIX = ("base", "smooth"), (0, 1), 0.5


def fold_logits(spark, sf) -> DataFrame:
    """Held-out logits: one array over the labels per (recipe, seed, id)."""
    grid = F.array(*[F.struct(F.lit(r).alias("recipe"), F.lit(s).alias("seed")) for r in RECIPES for s in SEEDS])
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.explode(grid).alias("g"))
    e = e.select("id", "label", "g.recipe", "g.seed").withColumn(
        "bump", F.when(hash_unit("g-", F.col("seed"), "-", F.col("id")) < 0.8, 2.0).otherwise(0.0))
    z = [3 * hash_unit("z-", F.col("recipe"), "-", F.col("seed"), "-", F.col("id"), f"-{lab}")
         + F.when(F.col("label") == lab, F.col("bump")).otherwise(0.0) for lab in LABELS]
    return once(e, z=F.array(*z)).drop("bump")


FL = f"""fl AS (SELECT recipe, seed, vec_id AS id, label, list_transform(range(10), lambda l: 3*{sql_hunit("'z-'||recipe||'-'||seed||'-'||vec_id||'-'||l")}
 + CASE WHEN l=label AND {sql_hunit("'g-'||seed||'-'||vec_id")}<0.8 THEN 2 ELSE 0 END) AS z
 FROM embeddings, (VALUES ('base'),('smooth')) r(recipe), (VALUES (0),(1)) s(seed))"""


def scored(spark, sf) -> DataFrame:
    """Predictions from the logits at a fixed temperature."""
    p = once(fold_logits(spark, sf), probs=softmax(F.col("z"), T_FIX))
    ranked = F.transform(F.slice(F.sort_array(F.transform("probs", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), asc=False), 1, 3),
                         lambda e: -e["i"])
    p = once(p, top3=ranked).withColumn("conf", F.array_max("probs")).withColumn("pred", F.col("top3")[0])
    return p.withColumn("ok", is_correct(F.col("label"), F.col("pred"), META)).withColumn("sens", is_sensitive(F.col("pred"), META))


SC = FL + f""", sm0 AS (SELECT *, list_max(z) AS mx FROM fl), sm1 AS (SELECT *, list_transform(z, lambda x: exp((x-mx)/{T_FIX}::DOUBLE)) AS ex FROM sm0),
 sm2 AS (SELECT *, list_sum(ex) AS se FROM sm1), sm3 AS (SELECT *, list_transform(ex, lambda x: x/se) AS probs FROM sm2),
 scored0 AS (SELECT recipe, seed, id, label, z, probs, list_max(probs) AS conf, (list_position(z,mx)-1)::INT AS pred,
  list_transform(list_sort(list_transform(range(10), lambda i: (-z[i+1], i)))[1:3], lambda e: e[2]) AS top3 FROM sm3),
 scored AS (SELECT *, {sql_ok()} AS ok, {sql_sens()} AS sens FROM scored0)"""


def pairs(spark, sf) -> DataFrame:
    """(task, message) pairs: a conversation's first user turn with each later user turn of the
    same conversation (related) and of the next one (unrelated)."""
    u = table(spark, sf, "conversations").filter("role = 'user'")
    first = u.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"), F.count("*").alias("user_turns")).select(
        "conv_id", F.col("f.turn").alias("first_turn"), F.col("f.text").alias("task"), "user_turns")
    later = u.join(first.select("conv_id", "first_turn"), "conv_id").filter("turn > first_turn").select(
        F.col("conv_id").alias("from_conv"), "turn", F.col("text").alias("message"))
    both = F.explode(F.array(
        F.struct(F.col("from_conv").alias("conv_id"), F.lit(True).alias("related")),
        F.struct((F.col("from_conv") - 1).alias("conv_id"), F.lit(False).alias("related"))))
    p = later.select("*", both.alias("b")).select("turn", "message", "b.*").join(first.drop("first_turn"), "conv_id")
    a, b = F.array_distinct(tokens(F.col("task"))), F.array_distinct(tokens(F.col("message")))
    p = once(p, ta=a, tb=b).withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    ga, gb = char_ngrams(F.lower("task"), 2), char_ngrams(F.lower("message"), 2)
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    return once(p, ga=ga, gb=gb).join(lang, "conv_id").select(
        F.concat_ws("-", "conv_id", "turn", F.when(F.col("related"), "r").otherwise("u")).alias("id"), "conv_id", "lang", "task", "message",
        "related", "user_turns", F.size(tokens(F.col("message"))).alias("words"),
        (F.col("shared") * 0.25).alias("bm25"), (F.col("shared") / F.sqrt(F.size("ta") * F.size("tb"))).alias("cos"),
        jaccard(F.col("ga"), F.col("gb")).alias("jac"))


SQL_TOK = r"list_filter(regexp_split_to_array(lower({}),'[^\p{{L}}\p{{N}}]+'), lambda t: t<>'')"
PAIRS_SQL = f"""u AS (SELECT * FROM conversations WHERE role='user'),
 fst AS (SELECT conv_id, min(turn) AS first_turn, arg_min(text,turn) AS task, count(*) AS user_turns FROM u GROUP BY conv_id),
 lat AS (SELECT u.conv_id AS from_conv, turn, text AS message FROM u JOIN fst USING (conv_id) WHERE turn>first_turn),
 pr0 AS (SELECT turn, message, from_conv AS conv_id, true AS related FROM lat UNION ALL SELECT turn, message, from_conv-1, false FROM lat),
 pr1 AS (SELECT p.*, f.task, f.user_turns, d.lang, {SQL_TOK.format('message')} AS tm, list_distinct({SQL_TOK.format('f.task')}) AS ta, list_distinct({SQL_TOK.format('message')}) AS tb,
  {sql_grams('lower(f.task)', 2)} AS ga, {sql_grams('lower(message)', 2)} AS gb FROM pr0 p JOIN fst f USING (conv_id) JOIN documents d ON d.doc_id=p.conv_id),
 pairs AS (SELECT conv_id||'-'||turn||'-'||CASE WHEN related THEN 'r' ELSE 'u' END AS id, conv_id, lang, task, message, related, user_turns, len(tm)::INT AS words,
  len(list_intersect(ta,tb))*0.25::DOUBLE AS bm25, len(list_intersect(ta,tb))/sqrt(len(ta)*len(tb)) AS cos,
  len(list_intersect(ga,gb))::DOUBLE/greatest(1,len(ga)+len(gb)-len(list_intersect(ga,gb))) AS jac FROM pr1)"""


# --- models that are expressions -----------------------------------------------------------


@query("m2_softmax_t", f"WITH {SC} SELECT recipe, seed, id, pred, round(conf,9) AS conf, round(probs[1],9) AS p0 FROM scored")
def m2(spark, sf):
    s = MO.softmax_t(fold_logits(spark, sf), "z", T_FIX)
    return s.select("recipe", "seed", "id", "pred", *r9("conf"), F.round(F.col("probs")[0], 9).alias("p0"))


@query("m5_ensemble_logits", f"WITH {FL} SELECT id, l::INT AS label, round(avg(z[l+1]),9) AS z FROM fl, (SELECT unnest(range(10)) AS l) GROUP BY ALL")
def m5(spark, sf):
    return MO.ensemble_logits(fold_logits(spark, sf), "z").select("id", "label", *r9("z"))


@query("m6_blend", f"""WITH {PAIRS_SQL}, s AS (SELECT avg(jac) AS ma, stddev_pop(jac) AS sa, avg(cos) AS mb, stddev_pop(cos) AS sb FROM pairs)
 SELECT id, round(0.3*jac+0.7*cos,9) AS blend, round(0.3*(jac-ma)/sa+0.7*(cos-mb)/sb,6) AS zblend, round(CASE WHEN lang='en' THEN jac ELSE cos END,9) AS routed FROM pairs, s""")
def m6(spark, sf):
    p = pairs(spark, sf)
    out = MO.zscore_blend(p, "jac", "cos", 0.3)
    return out.select("id", F.round(MO.blend(F.col("jac"), F.col("cos"), 0.3), 9).alias("blend"), F.round("zblend", 6).alias("zblend"),
                      F.round(F.when(F.col("lang") == "en", F.col("jac")).otherwise(F.col("cos")), 9).alias("routed"))


# --- calibration -----------------------------------------------------------------------------
LT = ",".join(f"({t}::DOUBLE)" for t in C.LOCKED_TAU)
LTS = ",".join(f"({t}::DOUBLE)" for t in C.LOCKED_TAU_S)


def sql_sweep(src, grid="lg", by=""):
    key = f"{by}, " if by else ""
    return f"""(SELECT {key}tau, tau_s, count(*) AS n, count_if(a)::BIGINT AS accepted, count_if(a)/count(*) AS cov,
 CASE WHEN count_if(a)>0 THEN count_if(a AND ok)/count_if(a) ELSE 0 END AS sel, count_if(a AND sens AND pred<>label)::BIGINT AS fe,
 CASE WHEN count_if(a AND sens)>0 THEN count_if(a AND sens AND ok)/count_if(a AND sens) ELSE 1 END AS sens_prec
 FROM (SELECT *, conf>=CASE WHEN sens THEN greatest(tau,tau_s) ELSE tau END AS a FROM {src}, {grid}) GROUP BY ALL)"""


LG = f"lg AS (SELECT tau, tau_s FROM (VALUES {LT}) a(tau), (VALUES {LTS}) b(tau_s))"


@query("c2_threshold_sweep", f"WITH {PREDS}, {LG} SELECT tau, tau_s, n, accepted, round(cov,9) AS cov, round(sel,9) AS sel, fe, round(sens_prec,9) AS sens_prec FROM {sql_sweep('preds')}")
def c2(spark, sf):
    s = C.threshold_sweep(preds(spark, sf), C.grid_points(tau=C.LOCKED_TAU, tau_s=C.LOCKED_TAU_S))
    return s.select("tau", "tau_s", "n", "accepted", *r9("cov", "sel"), "fe", *r9("sens_prec"))


@query("j8_grid_join", f"WITH {PREDS}, {LG}, x AS (SELECT *, conf>=CASE WHEN sens THEN greatest(tau,tau_s) ELSE tau END AS accepted FROM preds, lg) SELECT tau, tau_s, accepted, ok, sens, count(*) AS n FROM x GROUP BY ALL")
def j8(spark, sf):
    c = C.threshold_counts(preds(spark, sf), C.grid_points(tau=C.LOCKED_TAU, tau_s=C.LOCKED_TAU_S))
    return c.groupBy("tau", "tau_s", "accepted", "ok", "sens").agg(F.sum("n").alias("n"))


# The grid over which this rule is defined.
TAUS70 = [i / 100 for i in range(30, 100)]
T70 = "t70 AS (SELECT i/100 AS tau, 0::DOUBLE AS tau_s FROM (SELECT unnest(range(30,100)) AS i))"


@query("c3_smallest_tau", f"WITH {PREDS}, {T70}, s AS {sql_sweep('preds', 't70')} SELECT t AS target, coalesce(min(tau) FILTER (accepted>=5 AND sel>=t),0.99::DOUBLE) AS tau FROM s, (VALUES (0.8::DOUBLE),(0.9::DOUBLE),(0.976::DOUBLE)) v(t) GROUP BY t")
def c3(spark, sf):
    p = preds(spark, sf)
    return reduce(DataFrame.unionByName, [
        C.smallest_tau(p, TAUS70, t).select(F.lit(t).alias("target"), "tau") for t in (0.8, 0.9, 0.976)])


@query("c4_sensitive_tau", f"WITH {PREDS}, g AS (SELECT i/100 AS tau, i/100 AS tau_s FROM (SELECT unnest(range(95,100)) AS i)), s AS {sql_sweep('preds', 'g')} SELECT coalesce(min(tau_s) FILTER (sens_prec>=0.97),0.99::DOUBLE) AS tau_s FROM s")
def c4(spark, sf):
    return C.sensitive_tau(preds(spark, sf), 0.8)


LOCK = "ORDER BY cov DESC, tau_s, tau LIMIT 1"


@query("c5_locked_rule", f"WITH {PREDS}, {LG}, s AS {sql_sweep('preds')} SELECT tau, tau_s, accepted, fe, round(cov,9) AS cov FROM s WHERE sel>=0.976 AND sens_prec>=0.997 {LOCK}")
def c5(spark, sf):
    return C.locked_rule(preds(spark, sf)).select("tau", "tau_s", "accepted", "fe", *r9("cov"))


@query("c6_per_label_tau", f"""WITH {SC}, g AS (SELECT * FROM (VALUES {LT}) a(tau)), s AS (SELECT pred, sens, tau, count(*) AS n, count_if(conf>=tau) AS an, count_if(conf>=tau AND ok) AS ak FROM scored, g GROUP BY ALL),
 p AS (SELECT pred, sens, any_value(n) AS n, coalesce(min(tau) FILTER (an>=20 AND ak/an>=CASE WHEN sens THEN 0.997::DOUBLE ELSE 0.976::DOUBLE END),0.99::DOUBLE) AS pick FROM s GROUP BY ALL)
 SELECT pred, n, CASE WHEN n<50 THEN CASE WHEN sens THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END WHEN sens THEN greatest(0.95::DOUBLE,pick) ELSE pick END AS tau FROM p""")
def c6(spark, sf):
    return C.per_label_tau(scored(spark, sf), 0.8, 0.95)


def sql_temp(src, name, passes=4, steps=20):
    out, lo, hi = [], "0.05::DOUBLE", "20::DOUBLE"
    for k in range(passes):
        rng = f"SELECT {lo} AS lo, {hi} AS hi" if k == 0 else f"SELECT lo, hi FROM {name}{k - 1}"
        out.append(f"""{name}{k} AS (SELECT t, nll, greatest(0.05,t-w) AS lo, least(20,t+w) AS hi FROM (SELECT i, any_value(t) AS t, any_value(w) AS w,
 avg(-ln(exp((z[label+1]-mx)/t)/list_sum(list_transform(z, lambda x: exp((x-mx)/t)))+1e-12)) AS nll FROM
 (SELECT i, lo+(hi-lo)/{steps}*i AS t, (hi-lo)/{steps} AS w, z, label, list_max(z) AS mx FROM {src}, ({rng}), (SELECT unnest(range({steps + 1})) AS i)) GROUP BY i)
 ORDER BY round(nll,12), i LIMIT 1)""")
    return ", ".join(out)


@query("c1_fit_temperature", f"WITH {FL}, {sql_temp('fl', 'tp')} SELECT round(t,6) AS t, round(nll,6) AS nll FROM tp3")
def c1(spark, sf):
    return C.fit_temperature(fold_logits(spark, sf), "z", F.col("label")).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


@query("c7_two_temperature", f"""WITH {FL}, fs AS (SELECT * FROM fl WHERE list_position(z,list_max(z))-1 IN (7,8,9)), fn AS (SELECT * FROM fl WHERE list_position(z,list_max(z))-1 NOT IN (7,8,9)),
 {sql_temp('fs', 'ts', 3)}, {sql_temp('fn', 'tn', 3)} SELECT true AS sens, round(t,6) AS t, round(nll,6) AS nll FROM ts2 UNION ALL SELECT false, round(t,6), round(nll,6) FROM tn2""")
def c7(spark, sf):
    am = (F.array_position("z", F.array_max("z")) - 1).cast("int")
    out = C.two_temperature(fold_logits(spark, sf), "z", F.col("label"), is_sensitive(am, META), passes=3)
    return out.select("sens", F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


@query("c8_quantile_bands", f"""WITH {PAIRS_SQL}, n AS (SELECT cos, row_number() OVER (ORDER BY cos)-1 AS k, count(*) OVER () AS n FROM pairs WHERE NOT related),
 p AS (SELECT cos, row_number() OVER (ORDER BY cos)-1 AS k, count(*) OVER () AS n FROM pairs WHERE related),
 h AS (SELECT cos AS hi FROM n WHERE k=least(n-1,ceil(0.95::DOUBLE*n))), l AS (SELECT cos AS lo FROM p WHERE k=floor(0.05::DOUBLE*n))
 SELECT round(hi,9) AS hi, round(least(lo,hi),9) AS lo FROM h, l""")
def c8(spark, sf):
    return C.quantile_bands(pairs(spark, sf), "cos", F.col("related")).select(*r9("hi", "lo"))


GRANT = dict(t=0.36, g=0.02, tl=0.33, gl=0.01)


@query("c9_grant_rule", f"WITH {TOPGAP} SELECT id, ((top>=0.36 AND gap>=0.02) OR (top_label IN (1,2,3) AND top>=0.33 AND gap>=0.01)) AND top_label<>0 AS granted FROM tg")
def c9(spark, sf):
    t = V.top1_gap(label_scores(spark, sf))
    lab = F.col("top_label")
    return t.select("id", C.grant(F.col("top"), F.col("gap"), lab.isin(1, 2, 3), lab == 0, **GRANT).alias("granted"))


TS, GS = [i / 100 for i in range(28, 46, 2)], [i / 200 for i in range(1, 11)]


@query("c10_calibrate_grant", f"""WITH {TOPGAP}, r AS (SELECT tg.*, (top_label=e.label OR (e.label=0 AND top_label IN (0,1))) AS ok, top_label IN (1,2,3) AS lookup, top_label=0 AS excluded, tg.id IN (SELECT doc_id FROM labels) AS part FROM tg JOIN e ON e.id=tg.id),
 g AS (SELECT a/100 AS t, b/200 AS g FROM (SELECT unnest(range(28,46,2)) AS a), (SELECT unnest(range(1,11)) AS b)),
 x AS (SELECT g.t, g.g, part, count(*) AS n, count_if(gr) AS a, count_if(gr AND ok) AS c FROM (SELECT *, ((top>=t AND gap>=g) OR (lookup AND top>=t-0.8::DOUBLE*g AND gap>=g/2)) AND NOT excluded AS gr FROM r, g) g GROUP BY ALL),
 gp AS (SELECT t, g, sum(a)/sum(n) AS cov, CASE WHEN sum(a)>0 THEN sum(c)/sum(a) ELSE 0 END AS sel, sum(a)::BIGINT AS granted, min(CASE WHEN a>0 THEN c/a ELSE 1 END) AS wp FROM x GROUP BY ALL)
 SELECT t, g, granted, round(cov,9) AS cov, round(sel,9) AS sel FROM gp WHERE granted>=10 AND sel>=0.1 AND wp>=0.1 ORDER BY cov DESC, t, g LIMIT 1""")
def c10(spark, sf):
    t = V.top1_gap(label_scores(spark, sf)).join(emb(spark, sf).select("id", "label"), "id")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("part"))
    p = F.col("top_label")
    df = t.join(lab, "id", "left").select("top", "gap", p.isin(1, 2, 3).alias("lookup"), (p == 0).alias("excluded"),
                                          is_correct(F.col("label"), p, META).alias("ok"), F.coalesce("part", F.lit(False)).alias("part"))
    return C.calibrate_grant(df, TS, GS, 0.1, 10, "part").select("t", "g", "granted", *r9("cov", "sel"))


def topics(spark, sf):
    return pairs(spark, sf).withColumn("gold", F.when(F.col("related"), "same").otherwise("new"))


CNS, CSS = [i / 100 for i in range(-10, 80)], [i / 100 for i in range(0, 95)]


@query("c11_topic_threshold_grid", f"""WITH {PAIRS_SQL}, g AS (SELECT a/100 AS cn, b/100 AS cs FROM (SELECT unnest(range(-10,80)) AS a), (SELECT unnest(range(95)) AS b) WHERE a<b),
 v AS (SELECT cn, cs, related, words>=4 AND user_turns>=3 AND bm25<=2 AND bm25<5 AND cos<cs AND cos<=cn AS nw FROM pairs, g),
 m AS (SELECT cn, cs, count_if(NOT related AND nw)/count_if(NOT related) AS r, count_if(related AND nw)/count_if(related) AS f FROM v GROUP BY ALL)
 SELECT cn, cs, round(r,9) AS switch_recall, round(f,9) AS false_switch, round((r+1-f)/2,9) AS bal FROM m WHERE f<=0.05::DOUBLE ORDER BY round((r+1-f)/2,12) DESC, cn, cs LIMIT 1""")
def c11(spark, sf):
    g = X.topic_threshold_grid(topics(spark, sf), CNS, CSS, bs=5.0, bn=2.0)
    return g.select("cn", "cs", *r9("switch_recall", "false_switch", "bal"))


@query("c14_eligibility_gates", f"""WITH {SC}, s AS (SELECT *, id IN (SELECT doc_id FROM labels) AS part, conf>=CASE WHEN sens THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS a FROM scored),
 m AS (SELECT recipe||':'||seed AS members, count_if(a)/count(*) AS cov, count_if(a AND ok)/count(*) AS primary_acc, count_if(a AND sens AND NOT ok AND part)::BIGINT AS fe_a,
 count_if(a AND sens AND NOT ok AND NOT part)::BIGINT AS fe_b, count_if(a AND sens AND NOT ok AND label<5)::BIGINT AS fe_c FROM s GROUP BY 1)
 SELECT members, fe_a, fe_b, fe_c, eligible, round(cov+primary_acc,9) AS score,
 eligible AND row_number() OVER (ORDER BY eligible DESC, round(cov+primary_acc,12) DESC, members)=1 AS chosen FROM (SELECT *, fe_a<=3 AND fe_b<=4 AND fe_c<=4 AS eligible FROM m)""")
def c14(spark, sf):
    a = accept(F.col("conf"), F.col("sens"), 0.5, 0.7)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("part"))
    s = scored(spark, sf).join(lab, "id", "left").withColumn("part", F.coalesce("part", F.lit(False)))
    fe = a & F.col("sens") & ~F.col("ok")
    m = s.groupBy(F.concat_ws(":", "recipe", "seed").alias("members")).agg(
        F.avg(a.cast("double")).alias("cov"), F.avg((a & F.col("ok")).cast("double")).alias("primary_acc"),
        F.count_if(fe & F.col("part")).alias("fe_a"), F.count_if(fe & ~F.col("part")).alias("fe_b"), F.count_if(fe & (F.col("label") < 5)).alias("fe_c"))
    g = C.eligibility_gates(m, {"fe_a": 3, "fe_b": 4, "fe_c": 4}, "cov", "primary_acc", "members")
    return g.select("members", "fe_a", "fe_b", "fe_c", "eligible", *r9("score"), "chosen")


@query("c15_closest_miss", f"""WITH {SC}, {LG}, s AS {sql_sweep('scored', by='recipe')},
 a AS (SELECT recipe, arg_max((tau,tau_s),(sel,-tau_s,-tau)) AS p FROM s GROUP BY recipe), b AS (SELECT recipe, arg_max((tau,tau_s),(sel,-tau_s,-tau)) AS p FROM s WHERE sens_prec>=0.997 GROUP BY recipe),
 c AS (SELECT recipe, arg_max((tau,tau_s),(sens_prec,-tau_s,-tau)) AS p FROM s WHERE sel>=0.976 GROUP BY recipe)
 SELECT a.recipe, a.p[1] AS a_tau, a.p[2] AS a_tau_s, b.p[1] AS b_tau, b.p[2] AS b_tau_s, c.p[1] AS c_tau, c.p[2] AS c_tau_s FROM a LEFT JOIN b USING (recipe) LEFT JOIN c USING (recipe)""")
def c15(spark, sf):
    s = C.threshold_sweep(scored(spark, sf), C.grid_points(tau=C.LOCKED_TAU, tau_s=C.LOCKED_TAU_S), ["recipe"])
    m = C.closest_miss(s, ["recipe"])
    return m.select("recipe", *[F.col(f"{p}.{t}").alias(f"{n}_{t}") for p, n in (("max_sel", "a"), ("best_prec_ok", "b"), ("best_sel_ok", "c")) for t in ("tau", "tau_s")])


@query("c16_oracle_tau", f"""WITH {PREDS}, {RUN2}, {T70}, u AS (SELECT 'a' AS run, * FROM preds UNION ALL SELECT 'b', * FROM run2), s AS {sql_sweep('u', 't70', 'run')}
 SELECT run, coalesce(min(tau) FILTER (accepted>=5 AND sel>=0.9),0.99::DOUBLE) AS tau FROM s GROUP BY run""")
def c16(spark, sf):
    u = preds(spark, sf).withColumn("run", F.lit("a")).unionByName(second_run(spark, sf).withColumn("run", F.lit("b")))
    return C.smallest_tau(u, TAUS70, 0.9, by=["run"])


@query("m14_select_best", f"WITH {SC}, {LG}, s AS {sql_sweep('scored', by='recipe, seed')}, k AS (SELECT *, row_number() OVER (PARTITION BY recipe, seed ORDER BY cov DESC, tau_s, tau) AS k FROM s WHERE sel>=0.9 AND fe<=2) SELECT recipe, seed, tau, tau_s, accepted FROM k WHERE k=1")
def m14(spark, sf):
    s = C.threshold_sweep(scored(spark, sf), C.grid_points(tau=C.LOCKED_TAU, tau_s=C.LOCKED_TAU_S), ["recipe", "seed"])
    b = C.select_best(s, (F.col("sel") >= 0.9) & (F.col("fe") <= 2), [F.desc("cov"), F.asc("tau_s"), F.asc("tau")], ["recipe", "seed"])
    return b.select("recipe", "seed", "tau", "tau_s", "accepted")


# --- decisions ------------------------------------------------------------------------------


@query("x1_accept", f"WITH {PREDS} SELECT id, conf>=CASE WHEN sens THEN 0.95 ELSE 0.8 END AS accepted FROM preds")
def x1(spark, sf):
    return preds(spark, sf).select("id", accept(F.col("conf"), F.col("sens"), 0.8, 0.95).alias("accepted"))


RULES = ([{"name": "00", "kind": "none", "a": 0.0, "s": 0.0, "g": 0.0}]
         + [{"name": f"a{a}s{s}", "kind": "agree", "a": a, "s": s, "g": 0.0} for a in (0.3, 0.4, 0.5, 0.6, 0.7) for s in (0.55, 0.6, 0.65, 0.7, 0.75)]
         + [{"name": f"l{s}g{g}", "kind": "l2", "a": 0.0, "s": s, "g": g} for s in (0.65, 0.7, 0.75, 0.78) for g in (0.03, 0.05, 0.07, 0.1)])
SQL_RULES = "rules(rule,kind,a,s,g) AS (VALUES " + ",".join(f"('{r['name']}','{r['kind']}',{r['a']}::DOUBLE,{r['s']}::DOUBLE,{r['g']}::DOUBLE)" for r in RULES) + ")"


def sql_stats(src, by, extra=""):
    ok, sens = sql_ok(p="final"), sql_sens("final")
    return f"""SELECT {by}, count(*) AS n, round(count_if({ok})/count(*),9) AS primary_acc, count_if(final<>0)::BIGINT AS accepted,
 round(CASE WHEN count_if(final<>0)>0 THEN count_if(final<>0 AND {ok})/count_if(final<>0) ELSE 0 END,9) AS acc_sel, count_if({sens} AND final<>label)::BIGINT AS sens_fe {extra} FROM {src} GROUP BY ALL"""


RESC = f", count_if(rescued)::BIGINT AS rescued, round(CASE WHEN count_if(rescued)>0 THEN count_if(rescued AND {sql_ok(p='final')})/count_if(rescued) ELSE 1 END,9) AS resc_prec"
SQL_CASCADE = f"""cs0 AS (SELECT *, head_p>=CASE WHEN head_label IN (7,8,9) THEN 0.97 ELSE 0.9 END AS hs FROM runs, rules),
 cs1 AS (SELECT *, NOT l2_confident AND NOT hs AND l2_label NOT IN (7,8,9) AND ((kind='agree' AND head_label=l2_label AND head_p>=a AND l2_score>=s AND l2_gap>=g) OR (kind='l2' AND l2_score>=s AND l2_gap>=g)) AS rescued FROM cs0),
 cs AS (SELECT rule, label, rescued, CASE WHEN l2_confident THEN l2_label WHEN hs THEN head_label WHEN rescued THEN l2_label ELSE 0 END AS final FROM cs1),
 st AS ({sql_stats('cs', 'rule', RESC)})"""


def cascade(spark, sf):
    return X.replay_cascade(runs(spark, sf), RULES, 0.9, 0.97, META)


def stats_out(df, *by):
    return df.withColumnRenamed("primary", "primary_acc").select(*by, "n", *r9("primary_acc"), "accepted", *r9("acc_sel"), "sens_fe")


@query("x2_replay_cascade", f"WITH {RUNS}, {SQL_RULES}, {SQL_CASCADE} SELECT * FROM st")
def x2(spark, sf):
    return cascade(spark, sf).withColumnRenamed("primary", "primary_acc").select(
        "rule", "n", *r9("primary_acc"), "accepted", *r9("acc_sel"), "sens_fe", "rescued", *r9("resc_prec"))


@query("x2_choose_rescue", f"WITH {RUNS}, {SQL_RULES}, {SQL_CASCADE} SELECT rule, rescued FROM st WHERE rule<>'00' AND resc_prec>=0.75 AND acc_sel>=(SELECT acc_sel FROM st WHERE rule='00')-0.05 ORDER BY round(primary_acc,6) DESC, rule DESC LIMIT 1")
def x2b(spark, sf):
    return X.choose_rescue(cascade(spark, sf), "00", prec=0.75, slack=0.05).select("rule", "rescued")


# The grid over which this rule is defined.
VETO = C.grid_points(tau=(0.87, 0.9, 0.93, 0.96), veto=(0, 1), ovr=(0, 0.9, 0.95, 0.97, 0.99))


def sql_veto(extra):
    return f"""vo0 AS (SELECT runs.*, tau, veto, ovr, greatest(0.95::DOUBLE,tau) AS ts FROM runs, (VALUES (0.87::DOUBLE),(0.9::DOUBLE),(0.93::DOUBLE),(0.96::DOUBLE)) a(tau), (VALUES (0::DOUBLE),(1::DOUBLE)) b(veto), (VALUES (0::DOUBLE),(0.9::DOUBLE),(0.95::DOUBLE),(0.97::DOUBLE),(0.99::DOUBLE)) c(ovr)),
 vo1 AS (SELECT *, layer=2 AND pred<>0 AND NOT degraded AND ovr>0 AND head_label<>pred AND head_label<>0 AND head_p>=greatest(ovr,CASE WHEN head_label IN (7,8,9) THEN ts ELSE 0 END){extra} AS ov FROM vo0),
 vo AS (SELECT tau, veto, ovr, label, ov, CASE WHEN layer=3 AND NOT degraded AND pred<>0 AND conf<CASE WHEN pred IN (7,8,9) THEN ts ELSE tau END THEN 0
  WHEN layer=2 AND pred<>0 AND degraded AND veto=1 AND head_label<>pred THEN 0 WHEN ov THEN head_label ELSE pred END AS final FROM vo1)"""


for _name, _sec, _extra in (("x3_replay_veto_override", None, ""), ("x3_replay_veto_override_secondary", "secondary", " AND head_label<>secondary")):
    @query(_name, f"WITH {RUNS}, {sql_veto(_extra)} {sql_stats('vo', 'tau, veto, ovr', ', count_if(ov)::BIGINT AS overrides')}")
    def x3(spark, sf, sec=_sec):
        out = X.replay_veto_override(runs(spark, sf), VETO, 0.95, META, sec)
        return stats_out(out, "tau", "veto", "ovr", "overrides")


@query("x4_replay_tau", f"""WITH {RUNS}, rt AS (SELECT tau, label, CASE WHEN layer=3 AND NOT degraded AND conf<CASE WHEN pred IN (7,8,9) THEN greatest(0.95::DOUBLE,tau) ELSE tau END THEN 0 ELSE pred END AS final
 FROM runs, (VALUES (0.85::DOUBLE),(0.9::DOUBLE),(0.95::DOUBLE),(0.98::DOUBLE)) a(tau)) {sql_stats('rt', 'tau')}""")
def x4(spark, sf):
    return stats_out(X.replay_tau(runs(spark, sf), [0.85, 0.9, 0.95, 0.98], 0.95, META), "tau")


@query("x5_replay_head_path", f"WITH {RUNS} SELECT id, (CASE WHEN NOT starts_with(reason,'head:') THEN pred WHEN head_p>=CASE WHEN head_label IN (7,8,9) THEN 0.9 ELSE 0.7 END THEN head_label ELSE 0 END)::INT AS final FROM runs")
def x5(spark, sf):
    return X.replay_head_path(runs(spark, sf), ["head:"], 0.7, 0.9, META).select("id", "final")


VOTE = dict(cs=0.35, cn=0.2, bs=5.0, bn=2.0)
SQL_VOTE = """tv0 AS (SELECT *, words<4 OR user_turns<3 AS guard, CASE WHEN bm25>=5 THEN 'same' WHEN bm25<=2 THEN 'new' ELSE 'unsure' END AS b,
 CASE WHEN cos>=0.35 THEN 'same' WHEN cos<=0.2 THEN 'new' ELSE 'unsure' END AS c, CASE WHEN related THEN 'same' ELSE 'new' END AS gold FROM pairs),
 tv AS (SELECT *, CASE WHEN NOT guard AND b='new' AND c='new' THEN 'new' ELSE 'same' END AS vote, NOT guard AND b<>'same' AND c<>'same' AND NOT (b='new' AND c='new') AND (b='new' OR c='new') AS escalate FROM tv0)"""


@query("x6_topic_vote", f"WITH {PAIRS_SQL}, {SQL_VOTE} SELECT id, vote, escalate FROM tv")
def x6(spark, sf):
    return X.topic_vote(topics(spark, sf), **VOTE).select("id", "vote", "escalate")


@query("x6_topic_metrics", f"""WITH {PAIRS_SQL}, {SQL_VOTE}, m AS (SELECT count(*) AS n, count_if(gold=vote)/count(*) AS acc, count_if(gold='new' AND vote='new')/count_if(gold='new') AS r, count_if(gold='same' AND vote='new')/count_if(gold='same') AS f, count_if(escalate)/count(*) AS e FROM tv)
 SELECT n, round(acc,9) AS acc, round(r,9) AS switch_recall, round(f,9) AS false_switch, round((r+1-f)/2,9) AS bal, round(e,9) AS escalation FROM m""")
def x6b(spark, sf):
    return X.topic_metrics(X.topic_vote(topics(spark, sf), **VOTE)).select("n", *r9("acc", "switch_recall", "false_switch", "bal", "escalation"))


@query("x7_to_bands", f"WITH {PREDS} SELECT CASE WHEN conf>=0.9 THEN 'high' WHEN conf<0.6 THEN 'low' ELSE 'mid' END AS band, ok, count(*) AS n FROM preds GROUP BY ALL")
def x7(spark, sf):
    return preds(spark, sf).groupBy(to_bands(F.col("conf"), 0.9, 0.6).alias("band"), "ok").agg(F.count("*").alias("n"))


# The grid over which this rule is defined.
KNN = [{"c": c, "agree": a} for c in (0.25, 0.3, 0.35, 0.4) for a in (0, 1)]


SQL_KNN = f"""{RUNS}, {E_SQL}, f AS (SELECT *, {sql_hint("'f-'||id")}%5 AS fold FROM e), kp AS (SELECT a.id, b.id AS rid, {SIM}(a.vec,b.vec) AS sim FROM f a JOIN f b ON a.fold<>b.fold),
 kn AS (SELECT id, max(sim) AS nn_sim, arg_min(rid,(-round(sim,12),rid)) AS nn FROM kp GROUP BY id), kr AS (SELECT r.*, nn_sim, e.label AS nn_label FROM runs r JOIN kn USING (id) JOIN e ON e.id=kn.nn),
 k0 AS (SELECT *, head_p>=CASE WHEN head_label IN (7,8,9) THEN 0.97 ELSE 0.9 END AS hs FROM kr, (VALUES (0.25::DOUBLE),(0.3::DOUBLE),(0.35::DOUBLE),(0.4::DOUBLE)) a(c), (VALUES (0),(1)) b(agree)),
 k1 AS (SELECT *, NOT l2_confident AND NOT hs AND nn_sim>=c AND nn_label NOT IN (7,8,9) AND (agree=0 OR head_label=nn_label) AS rescued FROM k0),
 k2 AS (SELECT c, agree, label, rescued, CASE WHEN l2_confident THEN l2_label WHEN hs THEN head_label WHEN rescued THEN nn_label ELSE 0 END AS final FROM k1)"""


@query("x8_knn_rescue_replay", f"WITH {SQL_KNN} {sql_stats('k2', 'c, agree', RESC)}")
def x8(spark, sf):
    out = rescued_by_nearest(spark, sf, KNN)
    return out.withColumnRenamed("primary", "primary_acc").select(
        "c", "agree", "n", *r9("primary_acc"), "accepted", *r9("acc_sel"), "sens_fe", "rescued", *r9("resc_prec"))


def rescued_by_nearest(spark, sf, rules):
    f = emb(spark, sf).withColumn("fold", hash_int("f-", F.col("id")) % 5)
    near = V.nearest(f, f, skip_same="fold").select("id", F.col("max_cos").alias("nn_sim"), "nn")
    lab = f.select(F.col("id").alias("nn"), F.col("label").alias("nn_label"))
    return X.knn_rescue_replay(runs(spark, sf).join(near.join(lab, "nn"), "id"), rules, 0.9, 0.97, META)


# Precision asked for and accuracy that may be lost; at the second pair the given tables leave rules to choose from.
KNN_LIMITS = [(0.976, 0.002), (0.2, 0.1)]


def sql_knn_choice(prec, slack):
    return f"""(SELECT {prec}::DOUBLE AS prec, c, agree::INT AS agree, n, primary_acc, accepted, rescued, resc_prec FROM kt
 WHERE c IS NULL OR (resc_prec>={prec} AND sel>=(SELECT sel FROM kt WHERE c IS NULL)-{slack}) ORDER BY c IS NULL, round(primary_acc,6) DESC, c DESC, agree DESC LIMIT 1)"""


@query("x8_knn_rule_choice", f"""WITH {SQL_KNN}, kb AS (SELECT NULL::DOUBLE AS c, 0 AS agree, label, false AS rescued, CASE WHEN l2_confident THEN l2_label WHEN hs THEN head_label ELSE 0 END AS final FROM k0 WHERE c=0.25 AND agree=0),
 ks AS ({sql_stats('(SELECT * FROM k2 UNION ALL SELECT * FROM kb)', 'c, agree', RESC)}), kt AS (SELECT *, CASE WHEN accepted>0 THEN primary_acc*n/accepted ELSE 0 END AS sel FROM ks)
 {' UNION ALL '.join(sql_knn_choice(*x) for x in KNN_LIMITS)}""")
def x8_choice(spark, sf):
    stats = rescued_by_nearest(spark, sf, [{"c": None, "agree": 0}, *KNN])
    best = [X.choose_knn_rule(stats, *x).withColumn("prec", F.lit(x[0])) for x in KNN_LIMITS]
    return reduce(DataFrame.unionByName, best).withColumnRenamed("primary", "primary_acc").select(
        "prec", "c", "agree", "n", *r9("primary_acc"), "accepted", "rescued", *r9("resc_prec"))


@query("x9_fallback_fuse", f"""WITH {SC}, j AS (SELECT a.id, a.seed, a.probs, b.z AS s, list_transform(list_sort(list_transform(range(10), lambda i: (-a.z[i+1], i)))[1:5], lambda e: e[2]) AS top FROM scored a JOIN scored b ON a.id=b.id AND a.seed=b.seed AND a.recipe='base' AND b.recipe='smooth' WHERE a.conf<0.9)
 SELECT id, seed, top[1]::INT AS head, list_sort(list_transform(top, lambda i: (-s[i+1], i)))[1][2]::INT AS by_score, list_sort(list_transform(top, lambda i: (-(ln(probs[i+1]+1e-9)+s[i+1]), i)))[1][2]::INT AS by_fusion FROM j""")
def x9(spark, sf):
    s = scored(spark, sf)
    b = s.filter("recipe = 'smooth'").select("id", "seed", F.col("z").alias("second"))
    out = X.fallback_fuse(s.filter("recipe = 'base'").join(b, ["id", "seed"]), "probs", "second", 0.9)
    return out.select("id", "seed", *[F.col(c).cast("int").alias(c) for c in ("head", "by_score", "by_fusion")])


# --- evaluation -------------------------------------------------------------------------------


@query("e1_classification_summary", f"""WITH {SC}, s AS (SELECT *, conf>=CASE WHEN sens THEN 0.7 ELSE 0.5 END AS a FROM scored)
 SELECT recipe, count(*) AS n, round(avg(ok::INT),9) AS top1, round(avg((list_contains(top3,label) OR (label=0 AND (list_contains(top3,0) OR list_contains(top3,1))))::INT),9) AS top3,
 round(avg(a::INT),9) AS coverage, round(count_if(a AND ok)/count_if(a),9) AS selective_acc, count_if(a AND sens AND pred<>label)::BIGINT AS fe_accepted, count_if(sens AND pred<>label)::BIGINT AS fe_any FROM s GROUP BY recipe""")
def e1(spark, sf):
    top3 = F.exists("top3", lambda p: is_correct(F.col("label"), p, META))
    s = M.classification_summary(scored(spark, sf), 0.5, 0.7, ["recipe"], top3)
    return s.select("recipe", "n", *r9("top1", "top3", "coverage", "selective_acc"), "fe_accepted", "fe_any")


BINS = "bn AS (SELECT ceil(conf*10)::INT AS bin, count(*) AS n, avg(ok::INT) AS acc, avg(conf) AS mean_conf FROM preds WHERE conf>0 GROUP BY 1)"


@query("e2_ece", f"WITH {PREDS}, {BINS} SELECT round(sum(n*abs(acc-mean_conf))/(SELECT count(*) FROM preds),9) AS ece FROM bn")
def e2(spark, sf):
    return M.ece(preds(spark, sf)).select(*r9("ece"))


@query("e3_reliability_bins", f"WITH {PREDS}, {BINS} SELECT bin, n, round(acc,9) AS acc, round(mean_conf,9) AS mean_conf FROM bn WHERE n>=5")
def e3(spark, sf):
    return M.reliability_bins(preds(spark, sf)).select("bin", "n", *r9("acc", "mean_conf"))


@query("e4_sliced_accuracy", f"""WITH {RUNS}, r AS (SELECT *, {sql_ok()} AS ok FROM runs) SELECT 'layer' AS dim, layer::VARCHAR AS value, count(*) AS n, round(avg(ok::INT),9) AS acc FROM r GROUP BY ALL
 UNION ALL SELECT 'label', label::VARCHAR, count(*), round(avg(ok::INT),9) FROM r GROUP BY ALL UNION ALL SELECT 'layerxlabel', layer||'/'||label, count(*), round(avg(ok::INT),9) FROM r GROUP BY ALL""")
def e4(spark, sf):
    r = runs(spark, sf).withColumn("ok", is_correct(F.col("label"), F.col("pred"), META))
    return M.sliced_accuracy(r, ["layer", "label"], [("layer", "label")]).select("dim", "value", "n", *r9("acc"))


@query("e5_binned_accuracy", f"WITH {PREDS} SELECT ((conf>=0.6)::INT+(conf>=0.75)::INT+(conf>=0.9)::INT)::INT AS bin, count(*) AS n, round(avg(ok::INT),9) AS acc FROM preds GROUP BY 1")
def e5(spark, sf):
    return M.binned_accuracy(preds(spark, sf), "conf", [0.6, 0.75, 0.9]).select("bin", "n", *r9("acc"))


@query("e6_top_confusions", f"WITH {PREDS} SELECT label, pred, count(*) AS n FROM preds WHERE NOT ok GROUP BY ALL ORDER BY n DESC, label, pred LIMIT 15")
def e6(spark, sf):
    return M.top_confusions(preds(spark, sf), 15)


def sql_auc(src, score, by=None, w="1"):
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""(SELECT {key}any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, sum(p*(nb+n/2))/(any_value(n_pos)*any_value(n_neg)) AS auc FROM (
 SELECT *, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS nb, sum(p) OVER ({part}) AS n_pos, sum(n) OVER ({part}) AS n_neg FROM (
 SELECT {key}{score} AS s, sum(CASE WHEN y THEN {w} ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE {w} END) AS n FROM {src} GROUP BY ALL)) WHERE n_pos>0 AND n_neg>0 GROUP BY ALL)"""


@query("e7_auc", f"WITH {PREDS}, d AS (SELECT round(conf,2) AS c, ok AS y FROM preds) SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc,9) AS auc FROM {sql_auc('d', 'c')}")
def e7(spark, sf):
    return M.auc(preds(spark, sf).withColumn("c", F.round("conf", 2)), "c", F.col("ok")).select("n_pos", "n_neg", *r9("auc"))


@query("e8_auc_by", f"WITH {PAIRS_SQL}, d AS (SELECT *, related AS y FROM pairs) SELECT lang, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc,9) AS auc FROM {sql_auc('d', 'jac', 'lang')}")
def e8(spark, sf):
    return M.auc(pairs(spark, sf), "jac", F.col("related"), ["lang"]).select("lang", "n_pos", "n_neg", *r9("auc"))


@query("e9_latency_percentiles", f"""WITH {RUNS}, s AS (SELECT ms, 'all' AS slice FROM runs UNION ALL SELECT ms, 'confident' FROM runs WHERE l2_confident UNION ALL SELECT ms, 'escalated' FROM runs WHERE layer=3)
 SELECT slice, count(*) AS n, round(quantile_cont(ms,0.5),6) AS p50, round(quantile_cont(ms,0.95),6) AS p95, round(quantile_cont(ms,0.99),6) AS p99, round(max(ms),6) AS max FROM s GROUP BY slice""")
def e9(spark, sf):
    s = M.latency_percentiles(runs(spark, sf), "ms", {"all": F.lit(True), "confident": F.col("l2_confident"), "escalated": F.col("layer") == 3})
    return s.select("slice", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")])


BOOT = 2000
SQL_CDF = "[" + ",".join(f"{c!r}" for c in M.POISSON1_CDF) + "]::DOUBLE[]"


def sql_w(seed, key="id"):
    u = sql_hunit(f"'{seed}-'||rep||'-'||{key}")
    return f"len(list_filter({SQL_CDF}, lambda c: c<={u}))"


@query("e10_bootstrap_mean_ci", f"""WITH {PREDS}, {RUN2}, d AS (SELECT id, a.ok::INT-b.ok::INT AS d FROM preds a JOIN run2 b USING (id)), w AS (SELECT rep, d, {sql_w('b7')} AS w FROM d, (SELECT unnest(range({BOOT})) AS rep)),
 m AS (SELECT rep, sum(w*d)/sum(w) AS m FROM w GROUP BY rep), s AS (SELECT list_sort(list(m)) AS s FROM m) SELECT len(s)::INT AS replicates, round(s[51],9) AS lo, round(s[1951],9) AS hi FROM s""")
def e10(spark, sf):
    d = preds(spark, sf).select("id", F.col("ok").alias("a")).join(second_run(spark, sf).select("id", F.col("ok").alias("b")), "id")
    return M.bootstrap_mean_ci(d, "id", F.col("a").cast("int") - F.col("b").cast("int"), BOOT, "b7", 50, 1950).select("replicates", *r9("lo", "hi"))


SQL_BAL = "(sum(CASE WHEN related AND {0}>={1} THEN w ELSE 0 END)/sum(CASE WHEN related THEN w ELSE 0 END)+sum(CASE WHEN NOT related AND {0}<{1} THEN w ELSE 0 END)/sum(CASE WHEN related THEN 0 ELSE w END))/2"


@query("e11_bootstrap_metric_ci", f"""WITH {PAIRS_SQL}, w AS (SELECT *, {sql_w('b9')} AS w FROM pairs, (SELECT unnest(range({BOOT})) AS rep)), l AS (SELECT rep, 'a' AS m, jac AS s, related AS y, w FROM w WHERE w>0 UNION ALL SELECT rep, 'b', cos, related, w FROM w WHERE w>0),
 ua AS {sql_auc('l', 's', 'rep, m', 'w')}, ad AS (SELECT rep, sum(CASE WHEN m='a' THEN auc ELSE -auc END) AS v FROM ua GROUP BY rep),
 bd AS (SELECT rep, {SQL_BAL.format('jac', '0.45')}-{SQL_BAL.format('cos', '0.25')} AS v FROM w WHERE w>0 GROUP BY rep),
 s AS (SELECT 'auc' AS metric, list_sort(list(v)) AS s FROM ad UNION ALL SELECT 'balanced', list_sort(list(v)) FROM bd)
 SELECT metric, len(s)::INT AS replicates, round(s[51],9) AS lo, round(s[1951],9) AS hi FROM s""")
def e11(spark, sf):
    p = pairs(spark, sf)
    auc = M.bootstrap_auc_diff_ci(p, "id", "jac", "cos", "related", BOOT, "b9", 50, 1950)
    y = F.col("related")

    def half(name, score, cut):
        return {f"{name}_up": y & (F.col(score) >= cut), f"{name}_down": ~y & (F.col(score) < cut)}

    def rate(name):
        return (F.col(f"{name}_up") / F.col("yes") + F.col(f"{name}_down") / F.col("no")) / 2

    sums = {"yes": y, "no": ~y, **half("a", "jac", 0.45), **half("b", "cos", 0.25)}
    bal = M.bootstrap_ci(p, "id", sums, rate("a") - rate("b"), BOOT, "b9", 50, 1950)
    both = auc.withColumn("metric", F.lit("auc")).unionByName(bal.withColumn("metric", F.lit("balanced")))
    return both.select("metric", "replicates", *r9("lo", "hi"))


@query("e12_paired_wins", f"WITH {PREDS}, {RUN2} SELECT count(*) AS n, count_if(a.ok AND NOT b.ok)::BIGINT AS only_a, count_if(NOT a.ok AND b.ok)::BIGINT AS only_b FROM preds a JOIN run2 b USING (id)")
def e12(spark, sf):
    d = preds(spark, sf).select("id", F.col("ok").alias("a")).join(second_run(spark, sf).select("id", F.col("ok").alias("b")), "id")
    return M.paired_wins(d, "a", "b")


@query("e13_band_rates", f"""WITH {PAIRS_SQL} SELECT round(count_if(related AND cos>=0.3)/count_if(related),9) AS rel_high, round(count_if(related AND cos<0.2)/count_if(related),9) AS rel_low,
 round(count_if(NOT related AND cos<0.2)/count_if(NOT related),9) AS un_low, round(count_if(NOT related AND cos>=0.3)/count_if(NOT related),9) AS un_high FROM pairs""")
def e13(spark, sf):
    return M.band_rates(pairs(spark, sf), "cos", F.col("related"), F.lit(0.3), F.lit(0.2)).select(*r9("rel_high", "rel_low", "un_low", "un_high"))


@query("e14_miss_categories", f"""WITH {RUNS} SELECT CASE WHEN pred=0 THEN 'declined' ELSE 'accepted-wrong' END||'/'||CASE WHEN {sql_ok(p='head_label')} THEN 'head-right' ELSE 'head-wrong' END AS category,
 layer, split_part(reason,':',1) AS path, count(*) AS n FROM runs WHERE NOT {sql_ok()} GROUP BY ALL""")
def e14(spark, sf):
    r = runs(spark, sf).withColumn("ok", is_correct(F.col("label"), F.col("pred"), META)).withColumn("path", F.substring_index("reason", ":", 1))
    return M.miss_categories(r, F.col("pred") == 0, is_correct(F.col("label"), F.col("head_label"), META), ["layer", "path"])


HEADS = f"WITH {PREDS}, {RUN2}, h AS (SELECT *, conf>=CASE WHEN sens THEN 0.95 ELSE 0.8 END AS a FROM (SELECT * FROM preds UNION ALL SELECT * FROM run2))"


def heads(spark, sf):
    return preds(spark, sf).unionByName(second_run(spark, sf))


@query("e15_focus_labels", f"{HEADS} SELECT label, round((3*count_if(a AND NOT ok)+count_if(NOT a))/count(*),9) AS score FROM h GROUP BY label ORDER BY score DESC, label LIMIT 5")
def e15(spark, sf):
    return M.focus_labels(heads(spark, sf), 0.8, 0.95, 5).select("label", *r9("score"))


@query("e15_focus_pairs", f"""{HEADS}, p AS (SELECT label, pred, count(*) AS n, count_if(a AND sens) AS fe FROM h WHERE NOT ok GROUP BY ALL),
 x AS ((SELECT label, pred, 0 AS src FROM p WHERE fe>0 ORDER BY fe DESC, label, pred LIMIT 8) UNION ALL (SELECT label, pred, 1 FROM p WHERE pred<>0 ORDER BY n DESC, label, pred LIMIT 12)) SELECT label, pred, min(src) AS src FROM x GROUP BY ALL""")
def e15b(spark, sf):
    return M.focus_pairs(heads(spark, sf), 0.8, 0.95, 0, 8, 12)


@query("e16_pooled_weighted", f"""WITH {PREDS}, f AS (SELECT {sql_hint("'fold-'||id")}%5 AS fold, count(*) AS n, avg(ok::INT) AS top1, count_if(sens AND pred<>label) AS fe FROM preds GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n*top1)/sum(n),9) AS top1, sum(fe)::BIGINT AS fe_any FROM f""")
def e16(spark, sf):
    p = preds(spark, sf).withColumn("fold", hash_int("fold-", F.col("id")) % 5)
    folds = M.classification_summary(p, 0.8, 0.95, ["fold"])
    return M.pooled_weighted(folds, "n", ["top1"], ["fe_any"]).select("n", *r9("top1"), "fe_any")


@query("e17_mean_sd_over_seeds", f"WITH {SC}, s AS (SELECT recipe, seed, avg(ok::INT) AS acc FROM scored GROUP BY ALL) SELECT recipe, round(avg(acc),9) AS mean, round(stddev_pop(acc),9) AS sd FROM s GROUP BY recipe")
def e17(spark, sf):
    s = scored(spark, sf).groupBy("recipe", "seed").agg(F.avg(F.col("ok").cast("double")).alias("acc"))
    return M.mean_sd_over_seeds(s, "acc", ["recipe"]).select("recipe", *r9("mean", "sd"))


@query("e18_shift_report", f"""WITH {PAIRS_SQL} SELECT count(*) AS n, round(avg(related::INT),9) AS pos_frac, median(length(task)) AS len_a_med, median(length(message)) AS len_b_med,
 round(avg(jac) FILTER (related),9) AS overlap_pos, round(avg(jac) FILTER (NOT related),9) AS overlap_neg FROM pairs""")
def e18(spark, sf):
    s = M.shift_report(pairs(spark, sf), F.col("related"), F.length("task"), F.length("message"), "jac")
    return s.select("n", *r9("pos_frac"), "len_a_med", "len_b_med", *r9("overlap_pos", "overlap_neg"))


@query("e18_shift_breakdown", f"""WITH {PAIRS_SQL}, d AS (SELECT p.*, related AS y, d.source AS gen FROM pairs p JOIN documents d ON d.doc_id=p.conv_id)
 SELECT 'lang' AS what, lang AS key, count(*) AS n, round(avg(y::INT),9) AS value FROM d GROUP BY lang UNION ALL SELECT 'gen', gen, count(*), round(avg(y::INT),9) FROM d GROUP BY gen
 UNION ALL SELECT 'auc', 'all', (n_pos+n_neg)::BIGINT, round(auc,9) FROM {sql_auc('d', 'jac')} UNION ALL SELECT 'auc_lang', lang, (n_pos+n_neg)::BIGINT, round(auc,9) FROM {sql_auc('d', 'jac', 'lang')}
 UNION ALL SELECT 'cjk', 'none', count_if(NOT regexp_matches(task||message,'[\u3400-\u9fff]'))::BIGINT, round(count_if(NOT regexp_matches(task||message,'[\u3400-\u9fff]'))/count(*),9) FROM d""")
def e18_parts(spark, sf):
    gen = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("gen"))
    p = pairs(spark, sf).join(gen, "conv_id")
    cjk = F.concat("task", "message").rlike("[\u3400-\u9fff]")
    return M.shift_breakdown(p, F.col("related"), "lang", "gen", "jac", cjk).select("what", "key", "n", *r9("value"))


SQL_BAND = "CASE WHEN {0}>=0.9 THEN 'high' WHEN {0}<0.6 THEN 'low' ELSE 'mid' END"


@query("e19_band_flips", f"""WITH {PREDS}, {RUN2}, j AS (SELECT a.conf AS s1, b.conf AS s2 FROM preds a JOIN run2 b USING (id)), m AS (SELECT *, least(abs(s1-0.9),abs(s1-0.6)) AS m FROM j)
 SELECT count(*) AS n, count_if({SQL_BAND.format('s1')}<>{SQL_BAND.format('s2')})::BIGINT AS flips, round(max(abs(s1-s2)),9) AS max_change, round(quantile_cont(m,0.05),9) AS margin_p05, round(quantile_cont(m,0.5),9) AS margin_med FROM m""")
def e19(spark, sf):
    return M.band_flips(preds(spark, sf), second_run(spark, sf), "id", "conf", 0.9, 0.6).select("n", "flips", *r9("max_change", "margin_p05", "margin_med"))


@query("e20_layer_and_reason_counts", f"""WITH {RUNS} SELECT 'layer:'||layer AS what, count(*) AS n FROM runs GROUP BY 1 UNION ALL SELECT 'reason:'||t, count(*) FROM runs, (VALUES ('timeout'),('confident'),('tau')) v(t) WHERE contains(reason,t) GROUP BY 1""")
def e20(spark, sf):
    return M.layer_and_reason_counts(runs(spark, sf), ["timeout", "confident", "tau"])


@query("e21_learning_curve_table", f"""WITH {PREDS}, {LG}, r AS ({sql_rank('lc')}), sub AS (SELECT p.*, f AS frac FROM preds p JOIN r ON r.id=p.id, (SELECT unnest([0.25,0.5,0.75,1.0]::DOUBLE[]) AS f) WHERE rn<=round_even(f*size,0)),
 s AS {sql_sweep('sub', by='frac')}, k AS (SELECT *, row_number() OVER (PARTITION BY frac ORDER BY cov DESC, tau_s, tau) AS k FROM s WHERE sel>=0.9 AND sens_prec>=0.9), t AS {sql_sweep('preds')}
 SELECT k.frac, k.tau, k.tau_s, k.accepted, t.accepted AS test_accepted, round(t.sel,9) AS test_sel, t.fe AS test_fe FROM k JOIN t ON t.tau=k.tau AND t.tau_s=k.tau_s WHERE k=1""")
def e21(spark, sf):
    p = preds(spark, sf)
    sub = SP.learning_curve_subsets(p, "id", [0.25, 0.5, 0.75, 1.0], "lc")
    rule = C.locked_rule(sub, 0.9, 0.9, ["frac"]).select("frac", "tau", "tau_s", "accepted")
    test = C.threshold_sweep(p, C.grid_points(tau=C.LOCKED_TAU, tau_s=C.LOCKED_TAU_S)).select(
        "tau", "tau_s", F.col("accepted").alias("test_accepted"), F.round("sel", 9).alias("test_sel"), F.col("fe").alias("test_fe"))
    return rule.join(test, ["tau", "tau_s"]).select("frac", "tau", "tau_s", "accepted", "test_accepted", "test_sel", "test_fe")


@query("e22_policy_table", f"""WITH {PREDS}, g(tau,tau_s) AS (SELECT a, b FROM (VALUES (0.5::DOUBLE),(0.7::DOUBLE),(0.9::DOUBLE)) x(a), (VALUES (0.9::DOUBLE),(0.95::DOUBLE)) y(b)),
 s AS (SELECT *, conf>=CASE WHEN sens THEN greatest(tau,tau_s) ELSE tau END AS a, label IN (7,8,9) AS sg FROM preds, g)
 SELECT tau, tau_s, round(count_if(a)/count(*),9) AS coverage, round(CASE WHEN count_if(a)>0 THEN count_if(a AND ok)/count_if(a) ELSE 0 END,9) AS acc, count_if(a AND NOT ok)::BIGINT AS wrong,
 count_if(a AND sens AND pred<>label)::BIGINT AS sens_fe, round(count_if(a AND sg AND pred=label)/count_if(sg),9) AS sens_recall FROM s GROUP BY ALL""")
def e22(spark, sf):
    t = M.policy_table(preds(spark, sf), C.grid_points(tau=(0.5, 0.7, 0.9), tau_s=(0.9, 0.95)), is_sensitive(F.col("label"), META))
    return t.select("tau", "tau_s", *r9("coverage", "acc"), "wrong", "sens_fe", *r9("sens_recall"))


@query("e23_worst_labels", f"WITH {PREDS} SELECT label, count(*) AS n, round(1-avg(ok::INT),9) AS error FROM preds GROUP BY label ORDER BY error DESC, label LIMIT 5")
def e23(spark, sf):
    return M.worst_labels(preds(spark, sf), 5).select("label", "n", *r9("error"))


@query("e24_bench_summary", """WITH l AS (SELECT event_type AS run, 'value' AS metric, unnest([value, value+1]) AS v FROM events UNION ALL SELECT event_type, 'k', (props->>'k')::DOUBLE FROM events)
 SELECT run, metric, count(*) AS n, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.95),6) AS p95, round(avg(v),6) AS mean FROM l GROUP BY ALL""")
def e24(spark, sf):
    k = F.from_json("props", "k double")["k"]
    runs_ = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.create_map(
        F.lit("value"), F.array("value", F.col("value") + 1), F.lit("k"), F.array(k)).alias("metrics"))
    return M.bench_summary(runs_, "run", "metrics").select("run", "metric", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


@query("e25_config_table", f"""WITH {PREDS}, {RUN2}, u AS (SELECT 'first' AS method, * FROM preds UNION ALL SELECT 'second', * FROM run2)
 SELECT label, round(avg(ok::INT) FILTER (method='first'),9) AS first, round(avg(ok::INT) FILTER (method='second'),9) AS second FROM u GROUP BY label""")
def e25(spark, sf):
    u = preds(spark, sf).withColumn("method", F.lit("first")).unionByName(second_run(spark, sf).withColumn("method", F.lit("second")))
    acc = u.groupBy("label", "method").agg(F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"))
    return M.config_table(acc, "label", "method", ["first", "second"], "acc")
