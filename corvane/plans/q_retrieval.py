"""Queries R1-R12, C12, C13: every document is a task, the benchmark passages are the catalogue,
and a passage is gold for a document that holds it."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.text import norm_key_plain
from ..operators import calibrate as C
from ..operators import retrieval as R
from ..operators import vectors as V
from ..session import stored
from .base import query, spread, sql_key, table
from .q_vectors import E_SQL, SIM, emb


def tasks(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "lang", "text")


def index(spark, sf):
    return R.index_catalogue(R.numbered(table(spark, sf, "benchmark"), "item_id"), norm_key_plain)


def bm25(bm, bi, cos):
    return bm


def bigram(bm, bi, cos):
    return bi


def cosine(bm, bi, cos):
    return cos


def best(spark, sf, lists, **kw):
    """The documents' best passages, per name of lists."""
    return R.best_candidates(tasks(spark, sf), index(spark, sf), lists, **kw)


def r9(*cols):
    return [F.round(c, 9).alias(c) for c in cols]


def _grams(src, key):
    return f"""SELECT {key}, g FROM (SELECT {key}, unnest(CASE WHEN len(c)<2 THEN [array_to_string(c,'')] ELSE list_distinct(list_transform(range(1,len(c)), lambda i: c[i]||c[i+1])) END) AS g
 FROM (SELECT {key}, string_split(lower(text),'') AS c FROM {src}))"""


LEX = r"""cat AS (SELECT (row_number() OVER (ORDER BY item_id)-1)::INT AS pos, text FROM benchmark), dc AS (SELECT doc_id AS id, lang, text FROM documents),
 ct AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+')) AS term FROM cat) WHERE term<>'' GROUP BY ALL),
 cl AS (SELECT pos, sum(tf) AS dl, sum(tf*tf)::BIGINT AS sq FROM ct GROUP BY pos), cf AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
 cw AS (SELECT ct.pos, ct.term, ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)+1)*tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/avgdl)) AS w, tf AS ctf, cl.sq AS csq
  FROM ct JOIN cl USING (pos) JOIN cf USING (term), (SELECT count(*) AS n, avg(dl) AS avgdl FROM cl)),
 dt AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+')) AS term FROM dc) WHERE term<>'' GROUP BY ALL),
 dn AS (SELECT id, sum(tf*tf)::BIGINT AS sq FROM dt GROUP BY id),
 lex AS (SELECT id, pos, sum(w) AS bm25, sum(tf*ctf)::BIGINT/sqrt(any_value(sq)*any_value(csq)) AS cos FROM dt JOIN cw USING (term) JOIN dn USING (id) GROUP BY id, pos)"""
BIG = f"""dg AS ({_grams('dc', 'id')}), cg AS ({_grams('cat', 'pos')}), dgn AS (SELECT id, count(*) AS n FROM dg GROUP BY id), cgn AS (SELECT pos, count(*) AS n FROM cg GROUP BY pos),
 bi AS (SELECT id, pos, count(*) AS c FROM dg JOIN cg USING (g) GROUP BY ALL)"""
SIG = f"""{LEX}, {BIG}, mx AS (SELECT id, max(bm25) AS top FROM lex GROUP BY id),
 sg AS (SELECT d.id, d.lang, c.pos, coalesce(l.bm25,0)/coalesce(mx.top,1) AS bm25, coalesce(b.c,0)/(dgn.n+cgn.n-coalesce(b.c,0))::DOUBLE AS bigram, coalesce(l.cos,0) AS cos,
  contains({sql_key('d.text')}, {sql_key('c.text')}) AS gold FROM dc d CROSS JOIN cat c JOIN dgn ON dgn.id=d.id JOIN cgn ON cgn.pos=c.pos LEFT JOIN lex l ON l.id=d.id AND l.pos=c.pos LEFT JOIN bi b ON b.id=d.id AND b.pos=c.pos LEFT JOIN mx ON mx.id=d.id)"""


@query("r1_bm25", f"WITH {LEX} SELECT id, pos, round(bm25,9) AS bm25, round(cos,9) AS cos FROM lex")
def r1(spark, sf):
    return R.pair_scores(tasks(spark, sf), index(spark, sf)).select("id", "pos", *r9("bm25", "cos"))


@query("r2_bigram_overlap", f"WITH {SIG} SELECT id, round(max(bigram),9) AS best, round(sum(bigram),6) AS total, count_if(gold)::INT AS n_gold FROM sg GROUP BY id")
def r2(spark, sf):
    s = R.profiles(tasks(spark, sf), index(spark, sf))
    return s.select("id", *r9("best"), F.round("total", 6).alias("total"), F.size("known").alias("n_gold"))


def sql_select(src, base="0.2", wl="0.6", wb="1", extra="id"):
    sc = f"greatest({wl}::DOUBLE*bm25,{wb}::DOUBLE*bigram,greatest(0::DOUBLE,cos-{base}))"
    return f"SELECT *, row_number() OVER (PARTITION BY {extra} ORDER BY s DESC, pos) AS k FROM (SELECT *, {sc} AS s FROM {src}) WHERE s>=0.15"


FUSED = f"{SIG}, fz AS ({sql_select('sg')}), se AS (SELECT * FROM fz WHERE k<=5)"


def fused(spark, sf):
    return best(spark, sf, {"selected": (R.fused_score(0.6, 1.0, 0.2), 5, 0.15)})


@query("r3_fuse_max_select", f"WITH {FUSED} SELECT dc.id, coalesce(string_agg(pos,',' ORDER BY k),'') AS selected FROM dc LEFT JOIN se ON se.id=dc.id GROUP BY dc.id")
def r3(spark, sf):
    return fused(spark, sf).select("id", F.array_join(F.transform("selected", lambda x: x["pos"].cast("string")), ",").alias("selected"))


def sql_rank_metrics(src, by, ks):
    cols = ", ".join(f"round(avg(coalesce((p<={k})::INT,0)),9) AS r{k}" for k in ks)
    return f"SELECT {by}, count(*) AS n, {cols}, round(avg(coalesce(1/p,0)),9) AS mrr FROM {src} GROUP BY ALL"


ALPHAS = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
KS = (1, 3, 5, 10, 20)


@query("r4_fuse_alpha", f"""WITH {SIG}, fa AS (SELECT alpha, id, gold, row_number() OVER (PARTITION BY alpha, id ORDER BY round(alpha*bm25+(1-alpha)*cos,12) DESC, pos) AS k FROM sg, (SELECT unnest({ALPHAS!r}::DOUBLE[]) AS alpha)),
 fp AS (SELECT alpha, id, min(k) FILTER (gold) AS p FROM fa GROUP BY ALL) {sql_rank_metrics('fp', 'alpha', KS)}""")
def r4(spark, sf):
    def mixed(a):
        return lambda bm, bi, cos: np.round(a * bm + (1 - a) * cos, 12)

    places = R.gold_places(tasks(spark, sf), index(spark, sf), {f"p{i}": mixed(a) for i, a in enumerate(ALPHAS)})
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"p{i}").alias("place")) for i, a in enumerate(ALPHAS)]))
    return R.rank_metrics(places.select(each.alias("x")).select("x.*"), "place", ["alpha"]).select(
        "alpha", "n", *r9(*[f"r{k}" for k in KS], "mrr"))


TOP20 = "t20 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bm25 DESC, pos) AS k0 FROM sg), c20 AS (SELECT * FROM t20 WHERE k0<=20)"


@query("r5_rerank_candidates", f"""WITH {SIG}, {TOP20}, rr AS (SELECT id, gold, row_number() OVER (PARTITION BY id ORDER BY (1-0.7::DOUBLE)*bm25+0.7::DOUBLE*cos DESC, pos) AS k FROM c20),
 rp AS (SELECT dc.id, dc.lang, min(k) FILTER (gold) AS p FROM dc JOIN rr USING (id) GROUP BY ALL) {sql_rank_metrics('rp', 'lang', (1, 5))}""")
def r5(spark, sf):
    s = R.rerank_candidates(best(spark, sf, {"first": (bm25, 20, None)}), "first", 0.7)
    placed = s.select("lang", R.first_gold(F.col("order")).alias("p"))
    return R.rank_metrics(placed, "p", ["lang"], (1, 5)).select("lang", "n", *r9("r1", "r5", "mrr"))


@query("r6_rerank_by_score_table", f"""WITH {SIG}, {TOP20}, rr AS (SELECT id, gold, row_number() OVER (PARTITION BY id ORDER BY bigram DESC, pos) AS k FROM c20),
 rp AS (SELECT dc.id, dc.lang, min(k) FILTER (gold) AS p FROM dc JOIN rr USING (id) GROUP BY ALL) {sql_rank_metrics('rp', 'lang', (1, 5))}""")
def r6(spark, sf):
    s = stored(best(spark, sf, {"first": (bm25, 20, None)}), "first-stage")
    scores = s.select("id", F.explode("first").alias("x")).select("id", "x.pos", F.col("x.bigram").alias("score"))
    ranked = R.rerank_by_score_table(s, "first", scores).select("lang", R.first_gold(F.col("order")).alias("p"))
    return R.rank_metrics(ranked, "p", ["lang"], (1, 5)).select("lang", "n", *r9("r1", "r5", "mrr"))


UNION = [{"k": k, "theta": float(t), "n": n} for k in (3, 5) for t in (0.3, 0.5, 0.7) for n in (0, 5, 10)] + [{"k": 0, "theta": 0.0, "n": n} for n in (0, 5, 20)]


@query("r7_union_candidates", f"""WITH {SIG}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, pos) AS kh, row_number() OVER (PARTITION BY id ORDER BY bm25 DESC, pos) AS ka FROM sg),
 g(k,theta,first_n) AS (VALUES {",".join(f"({p['k']},{p['theta']}::DOUBLE,{p['n']})" for p in UNION)}),
 ug AS (SELECT k, theta, first_n, id, count_if(inc) AS sz, bool_or(inc AND gold) AS hit, bool_or(bigram>=0.4 AND gold) AS sh FROM (SELECT *, bigram>=0.4 OR (kh<=k AND cos>=theta) OR ka<=first_n AS inc FROM o, g) GROUP BY ALL)
 SELECT k, theta, first_n, count(*) AS n, round(avg(hit::INT),9) AS recall, round(avg(sz),9) AS mean_size, round(avg(sh::INT),9) AS scope_only FROM ug GROUP BY ALL""")
def r7(spark, sf):
    s = best(spark, sf, {"head": (cosine, 5, None), "first": (bm25, 20, None)}, scope=lambda bm, bi, cos: bi >= 0.4)
    return R.union_candidates(s, UNION, "head", "first", lambda x: x["bigram"] >= 0.4).select("k", "theta", "first_n", "n", *r9("recall", "mean_size", "scope_only"))


@query("r8_recall_at_k_mrr", f"""WITH {SIG}, o AS (SELECT id, lang, gold, row_number() OVER (PARTITION BY id ORDER BY bm25 DESC, pos) AS k FROM sg), rp AS (SELECT id, lang, min(k) FILTER (gold) AS p FROM o GROUP BY ALL)
 {sql_rank_metrics('rp', 'lang', KS)}""")
def r8(spark, sf):
    s = R.gold_places(tasks(spark, sf), index(spark, sf), {"p": bm25})
    return R.rank_metrics(s, "p", ["lang"]).select("lang", "n", *r9(*[f"r{k}" for k in KS], "mrr"))


@query("r9_ndcg_mrr_at_10", f"""WITH {E_SQL}, g AS (SELECT a.id, a.label, b.id AS gid, a.vec, {SIM}(a.vec,b.vec) AS gs FROM e a JOIN e b ON b.id=a.id+1),
 r AS (SELECT g.id, g.label, 1+count_if({SIM}(g.vec,e.vec)>gs+1e-12 AND e.id<>gid) AS rank FROM g JOIN e ON e.id<>g.id GROUP BY ALL)
 SELECT label, count(*) AS n, round(avg(CASE WHEN rank<=10 THEN 1/log2(rank+1) ELSE 0 END),9) AS ndcg, round(avg(CASE WHEN rank<=10 THEN 1/rank ELSE 0 END),9) AS mrr FROM r GROUP BY label""")
def r9q(spark, sf):
    e = emb(spark, sf)
    ranks = V.rank_of_gold(e.select("id", "vec"), e, e.select("id", (F.col("id") + 1).alias("gold_id")))
    return R.ndcg_mrr_at(ranks.join(e.select("id", "label"), "id"), "rank", by=["label"]).select("label", "n", *r9("ndcg", "mrr"))


def sql_prf(sel, by=""):
    key = f"{by}, " if by else ""
    using = f"USING ({key}id, pos)"
    return f"""SELECT {key}n, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(hit1,9) AS hit1, round(empty,9) AS empty, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,9) AS f1 FROM (
 SELECT {key}count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(h::INT) AS hit1, avg((ns=0)::INT) AS empty FROM (
 SELECT {key}id, count_if(k<=5 AND gold) AS tp, count_if(k<=5 AND NOT gold) AS fp, count_if(gold AND (k IS NULL OR k>5)) AS fn, coalesce(bool_or(k=1 AND gold),false) AS h, count(*) FILTER (k<=5) AS ns FROM {sel} GROUP BY ALL) GROUP BY ALL)"""


@query("r10_micro_prf", f"WITH {FUSED}, al AS (SELECT sg.id, sg.lang, sg.gold, fz.k FROM sg LEFT JOIN fz ON fz.id=sg.id AND fz.pos=sg.pos) {sql_prf('al', 'lang')}")
def r10(spark, sf):
    return R.prf_of_lists(fused(spark, sf), "selected", ["lang"]).select("lang", "n", "tp", "fp", "fn", *r9("hit1", "empty", "f1"))


@query("r11_rank_eval", f"""WITH {SIG}, o AS (SELECT id, lang, gold, row_number() OVER (PARTITION BY id ORDER BY cos DESC, pos) AS k FROM sg), rp AS (SELECT id, lang, min(k) FILTER (gold) AS p FROM o GROUP BY ALL)
 {sql_rank_metrics('rp', 'lang', (1, 5))}""")
def r11(spark, sf):
    s = R.gold_places(tasks(spark, sf), index(spark, sf), {"p": cosine})
    return R.rank_metrics(s, "p", ["lang"], (1, 5)).select("lang", "n", *r9("r1", "r5", "mrr"))


@query("r12_multi_config_compare", f"""WITH {SIG}, l AS (SELECT 'bm25' AS config, id, pos, gold, bm25 AS s FROM sg UNION ALL SELECT 'bigram', id, pos, gold, bigram FROM sg UNION ALL SELECT 'cos', id, pos, gold, cos FROM sg),
 o AS (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY s DESC, pos) AS k FROM l), rp AS (SELECT config, id, min(k) FILTER (gold) AS p FROM o GROUP BY ALL), m AS ({sql_rank_metrics('rp', 'config', (1, 5))})
 SELECT *, mrr=(SELECT max(mrr) FROM m) AS best FROM m""")
def r12(spark, sf):
    places = R.gold_places(tasks(spark, sf), index(spark, sf), {"bm25": bm25, "bigram": bigram, "cos": cosine})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("p")) for c in ("bm25", "bigram", "cos")]))
    m = R.rank_metrics(places.select(each.alias("x")).select("x.*"), "p", ["config"], (1, 5)).select("config", "n", *r9("r1", "r5", "mrr"))
    best = C.select_best(m, F.lit(True), [F.desc("mrr"), F.asc("config")]).select("mrr").scalar()
    return m.withColumn("best", F.col("mrr") == best)


BASES = [b / 100 for b in range(0, 70, 2)]


@query("c12_baseline_sweep", f"""WITH {SIG}, gd AS (SELECT b/100 AS base FROM (SELECT unnest(range(0,70,2)) AS b)), al0 AS (SELECT sg.*, base, greatest(bm25,bigram,greatest(0::DOUBLE,cos-base)) AS s FROM sg, gd),
 al AS (SELECT base, id, gold, CASE WHEN s>=0.15::DOUBLE THEN row_number() OVER (PARTITION BY base, id ORDER BY s>=0.15::DOUBLE DESC, s DESC, pos) END AS k FROM al0) SELECT base, n, tp, fp, fn, hit1, empty, f1 FROM ({sql_prf('al', 'base')})""")
def c12(spark, sf):
    out = R.fusion_sweep(tasks(spark, sf), index(spark, sf), C.grid_points(wl=[1.0], wb=[1.0], base=BASES))
    return out.select("base", "n", "tp", "fp", "fn", *r9("hit1", "empty", "f1"))


WEIGHTS = (0.6, 0.8, 1.0, 1.2)


@query("c13_fusion_weight_grid", f"""WITH {SIG}, gd AS (SELECT wl, wb, b/100 AS base FROM (SELECT unnest(range(0,80,2)) AS b), (VALUES (0.6::DOUBLE),(0.8::DOUBLE),(1::DOUBLE),(1.2::DOUBLE)) x(wl), (VALUES (0.6::DOUBLE),(0.8::DOUBLE),(1::DOUBLE),(1.2::DOUBLE)) y(wb)),
 al0 AS (SELECT id, pos, gold, wl, wb, base, greatest(wl*bm25,wb*bigram,greatest(0::DOUBLE,cos-base)) AS s FROM sg, gd),
 al AS (SELECT wl, wb, base, id, gold, CASE WHEN s>=0.15::DOUBLE THEN row_number() OVER (PARTITION BY wl, wb, base, id ORDER BY s>=0.15::DOUBLE DESC, s DESC, pos) END AS k FROM al0), m AS ({sql_prf('al', 'wl, wb, base')})
 SELECT wl, wb, base, f1 FROM (SELECT *, row_number() OVER (PARTITION BY wl, wb ORDER BY f1 DESC, base DESC) AS z FROM m) WHERE z=1""")
def c13(spark, sf):
    out = R.fusion_sweep(tasks(spark, sf), index(spark, sf), C.grid_points(wl=WEIGHTS, wb=WEIGHTS, base=[b / 100 for b in range(0, 80, 2)]))
    best = C.select_best(out.withColumn("f1", F.round("f1", 9)), F.lit(True), [F.desc("f1"), F.desc("base")], ["wl", "wb"])
    return best.select("wl", "wb", "base", "f1")
