"""Queries J*, D*, L*, T*: joins, de-duplication, label merging, splits."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_unit
from ..functions.rules import is_correct
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import labels as L
from ..operators import splits as X
from ..operators import text as O
from .base import (CAND, ITEMS, LABELS, META, PREDS, RUN2, RUNS, candidates_and_refs, items, judge_log, keyed, preds,
                   query, runs, second_run, spread, sql_hint, sql_hunit, sql_judge, sql_ok, table)
from .q_text import PRE, SQL_TOOLS, SUF, tools

# --- joins ---------------------------------------------------------------------------------


@query("j1_anti_join_attributed", f"WITH {CAND} SELECT c.id, r.ref_tag FROM cand c LEFT JOIN refs r ON c.key=r.key")
def j1(spark, sf):
    cand, refs = candidates_and_refs(spark, sf)
    return J.anti_join_attributed(cand, refs, "key").select("id", "ref_tag")


@query("j2_resume_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(spark, sf):
    return J.resume_anti_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@query("j3_common_ids", f"""WITH {PREDS}, {RUN2}, a AS (SELECT * FROM preds WHERE conf>=0.6), b AS (SELECT * FROM run2 WHERE conf>=0.6)
 SELECT id, a.ok AS a_ok, b.ok AS b_ok FROM a JOIN b USING (id)""")
def j3(spark, sf):
    a, b = preds(spark, sf).filter("conf >= 0.6"), second_run(spark, sf).filter("conf >= 0.6")
    ids = J.common_ids(a, b, "id")
    return ids.join(a.select("id", F.col("ok").alias("a_ok")), "id").join(b.select("id", F.col("ok").alias("b_ok")), "id")


@query("j4_subset", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=0)")
def j4(spark, sf):
    return J.subset(table(spark, sf, "documents"), table(spark, sf, "labels").filter("quality = 0"), "doc_id").select("doc_id", "source")


@query("j5_attach_vectors", "SELECT doc_id AS id, lang, round(embedding[1]::DOUBLE,6) AS first FROM documents JOIN embeddings ON doc_id=vec_id")
def j5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return J.attach_vectors(d, v, "id").select("id", "lang", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("j10_assert_disjoint", f"""WITH {CAND}, r AS (SELECT i.* FROM items i JOIN labels l ON i.id=l.doc_id)
 SELECT 'id' AS key, (SELECT count(*) FROM cand WHERE id IN (SELECT id FROM r)) AS violations
 UNION ALL SELECT 'key', (SELECT count(*) FROM cand WHERE key IN (SELECT key FROM r))""")
def j10(spark, sf):
    it = items(spark, sf)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return J.assert_disjoint(it.join(lab, "id", "left_anti"), it.join(lab, "id"), ["id", "key"])


@query("j11_run_diff", f"""WITH {PREDS}, {RUN2}, j AS (SELECT a.pred<>b.pred AS d_pred, a.ok<>b.ok AS d_ok, a.sens<>b.sens AS d_sens, abs(a.conf-b.conf) AS dc FROM preds a JOIN run2 b USING (id))
 SELECT f AS field, CASE f WHEN 'pred' THEN count_if(d_pred) WHEN 'ok' THEN count_if(d_ok) ELSE count_if(d_sens) END::BIGINT AS differing, count(*) AS n, round(max(dc),9) AS max_conf_diff
 FROM j, (VALUES ('pred'),('ok'),('sens')) v(f) GROUP BY f""")
def j11(spark, sf):
    d = J.run_diff(preds(spark, sf), second_run(spark, sf), "id", ["pred", "ok", "sens"], "conf")
    return d.withColumn("max_conf_diff", F.round("max_conf_diff", 9))


def perturbed_preds(spark, sf):
    """Predictions for perturbed copies of the embeddings' items: the label moves for a hashed share."""
    p = preds(spark, sf).select(F.col("id").cast("string").alias("id"), "label", "pred", "conf")
    forms = F.explode(F.array(*[F.struct(F.lit(s).alias("sfx"), F.lit(r).alias("rate")) for s, r in (("ps", 0.1), ("ty", 0.3), ("fw", 0.5))]))
    p = p.select("*", forms.alias("f"))
    key = F.concat_ws("-", "id", "f.sfx")
    moved = F.when(hash_unit("mv-", key) < F.col("f.rate"), (F.col("pred") + 1) % 10).otherwise(F.col("pred"))
    return p.select(key.alias("id"), F.col("f.sfx").alias("kind"), "label", moved.cast("int").alias("pred"))


@query("j12_perturbed_vs_base", f"""WITH {PREDS}, f(kind, rate) AS (VALUES ('ps',0.1),('ty',0.3),('fw',0.5)),
 p AS (SELECT kind, label, pred AS base_pred, CASE WHEN {sql_hunit("'mv-'||id||'-'||kind")}<rate THEN (pred+1)%10 ELSE pred END AS pred FROM preds, f)
 SELECT kind, count(*) AS n, round(avg({sql_ok()}::INT),9) AS acc, round(avg((pred=base_pred)::INT),9) AS unchanged FROM p GROUP BY kind""")
def j12(spark, sf):
    base = preds(spark, sf).withColumn("id", F.col("id").cast("string"))
    out = J.perturbed_vs_base(perturbed_preds(spark, sf), base, is_correct(F.col("label"), F.col("pred"), META), "kind")
    return out.select("kind", "n", F.round("acc", 9).alias("acc"), F.round("unchanged", 9).alias("unchanged"))


@query("j13_label_scope_join", f"""WITH {RUNS}, {SQL_TOOLS}, l AS (SELECT id, pred AS label FROM runs UNION SELECT id, secondary FROM runs),
 s AS (SELECT id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS scope FROM l JOIN tools t ON l.label=t.label GROUP BY id)
 SELECT r.id, coalesce(s.scope,'') AS scope FROM runs r LEFT JOIN s USING (id)""")
def j13(spark, sf):
    out = J.label_scope_join(runs(spark, sf), ["pred", "secondary"], F.broadcast(tools(spark)), "id")
    return out.select("id", F.array_join("scope", ",").alias("scope"))


# --- de-duplication ---------------------------------------------------------------------------


@query("d1_exact_dedup", f"WITH {ITEMS} SELECT min(id) AS id, arg_min(lang,id) AS lang, md5(key) AS key_md5 FROM items GROUP BY key")
def d1(spark, sf):
    return D.exact_dedup(keyed(items(spark, sf)).select("id", "lang", "key"), ["key"], ["id"]).withColumnRenamed("key", "key_md5")


@query("d2_pair_dedup", f"""WITH {ITEMS}, f AS (SELECT lang, fam, min(id) AS id FROM items GROUP BY ALL),
 p AS (SELECT i.id, i.fam||'/'||i.lang AS lk, i.key AS rk FROM items i), h AS (SELECT i.key FROM items i JOIN labels l ON i.id=l.doc_id WHERE toxic=1)
 SELECT min(id) AS id FROM p WHERE rk NOT IN (SELECT key FROM h) AND lk NOT IN (SELECT key FROM h) GROUP BY lk, rk""")
def d2(spark, sf):
    it = keyed(items(spark, sf))
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    pairs = it.select("id", F.md5(F.concat_ws("/", "fam", "lang")).alias("lk"), F.col("key").alias("rk"))
    return D.pair_dedup(pairs, "lk", "rk", "id", it.join(toxic, "id").select("key")).select("id")


@query("d3_content_hash_dedup", """WITH d AS (SELECT min(doc_id) AS id FROM documents GROUP BY md5(text)),
 r AS (SELECT id, row_number() OVER (ORDER BY md5(id||'seed7'), id)-1 AS seq FROM d) SELECT id, seq::BIGINT AS seq FROM r WHERE seq<900""")
def d3(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return D.shuffled_cap(D.content_hash_dedup(d, "text", "id").select("id"), "id", "seed7", 900)


@query("d9_dedup_catalogue", "SELECT source AS name, min(doc_id) AS id, arg_min(lang,doc_id) AS lang FROM documents GROUP BY source")
def d9(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "lang")
    return D.exact_dedup(d, ["name"], ["id"])


SQL_STATUS = CAND + """, st0 AS (SELECT c.*, r.ref_tag, length(trim(text))>=200 AS usable FROM cand c LEFT JOIN refs r ON c.key=r.key),
 f AS (SELECT key, min(id) AS first_id FROM st0 WHERE usable GROUP BY key),
 st AS (SELECT s.id, s.fam, CASE WHEN NOT usable THEN 'empty' WHEN ref_tag IS NOT NULL THEN 'dup_vs_'||ref_tag
  WHEN s.id=f.first_id THEN 'kept' ELSE 'dup_within' END AS status FROM st0 s LEFT JOIN f ON s.key=f.key)"""


@query("d10_funnel_counts", f"""WITH {SQL_STATUS} SELECT status, fam AS family, count(*) AS n FROM st GROUP BY ALL
 UNION ALL SELECT status, '*', count(*) FROM st GROUP BY status""")
def d10(spark, sf):
    cand, refs = candidates_and_refs(spark, sf)
    return D.funnel_counts_by_key(cand, "key", "id", "text", refs, 200, "fam")


@query("d12_already_judged_filter", f"WITH {CAND} SELECT id FROM cand WHERE key NOT IN (SELECT i.key FROM items i JOIN labels l ON i.id=l.doc_id)")
def d12(spark, sf):
    it = keyed(items(spark, sf)).select("id", "key")
    judged = it.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")
    return D.already_judged_filter(it, judged, "id", "key").select("id")


SQL_NGRAM = """g AS (SELECT id, unnest(list_distinct(list_transform(range(1,greatest(1,length(s)-2)+1), lambda i: substr(s,i,3)))) AS g FROM
  (SELECT doc_id AS id, regexp_replace(lower(text),'\\s+','','g') AS s FROM documents)),
 sz AS (SELECT id, count(*) AS n FROM g GROUP BY id), lab AS (SELECT doc_id AS id FROM labels),
 qg AS (SELECT * FROM g WHERE id NOT IN (SELECT id FROM lab)), rg AS (SELECT * FROM g WHERE id IN (SELECT id FROM lab)),
 sh AS (SELECT q.id, r.id AS rid, count(*) AS c FROM qg q JOIN rg r ON q.g=r.g GROUP BY ALL),
 jc AS (SELECT sh.id, rid, c::DOUBLE/(a.n+b.n-c) AS j FROM sh JOIN sz a ON a.id=sh.id JOIN sz b ON b.id=sh.rid),
 nd AS (SELECT id, max(j) AS max_jac, arg_min(rid, (-j, rid)) AS nn_jac FROM jc WHERE j>0.6 GROUP BY id)"""


def ngram_near(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id").withColumnRenamed("doc_id", "id").select("id", "text")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return D.near_dup_ngram(d.join(lab, "id", "left_anti"), d.join(lab, "id"), "id", "text", 0.6)


@query("d5_near_dup_ngram", f"WITH {SQL_NGRAM} SELECT id, round(max_jac,9) AS max_jac, nn_jac FROM nd")
def d5(spark, sf):
    return ngram_near(spark, sf).select("id", F.round("max_jac", 9).alias("max_jac"), "nn_jac")


# --- label merging ------------------------------------------------------------------------------
ALPHA, BETA = sql_judge("alpha"), sql_judge("beta")
LATEST = "{n}_last AS (SELECT id, arg_max(judge_label,pos)::INT AS judge_label FROM judge_{n} GROUP BY id)"
AGREE = f"""{ALPHA}, {BETA}, {LATEST.format(n='alpha')}, {LATEST.format(n='beta')},
 j AS (SELECT d.doc_id AS id, d.source AS fam, d.lang, a.judge_label AS gold, b.judge_label, 1-b.judge_label AS second,
  CASE WHEN a.judge_label IS NULL THEN 'unjudged' WHEN a.judge_label=b.judge_label OR (a.judge_label=0 AND b.judge_label IN (0)) THEN 'agree' ELSE 'disagree' END AS status
  FROM documents d LEFT JOIN alpha_last a ON a.id=d.doc_id LEFT JOIN beta_last b ON b.id=d.doc_id)"""


def agreed(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("fam"), "lang")
    gold = L.latest_label(judge_log(spark, sf, "alpha"), "id", ["pos"], "judge_label").withColumnRenamed("judge_label", "gold")
    judge = L.latest_label(judge_log(spark, sf, "beta"), "id", ["pos"], "judge_label")
    out = L.agree_filter(d.join(gold, "id", "left"), judge, "id", F.col("gold") == F.col("judge_label"))
    return out.withColumn("second", 1 - F.col("judge_label"))


@query("l1_latest_label", f"WITH {ALPHA}, {LATEST.format(n='alpha')} SELECT * FROM alpha_last")
def l1(spark, sf):
    return L.latest_label(judge_log(spark, sf, "alpha"), "id", ["pos"], "judge_label")


@query("l2_agree_filter", f"WITH {AGREE} SELECT fam, status, count(*) AS n FROM j GROUP BY ALL")
def l2(spark, sf):
    return agreed(spark, sf).groupBy("fam", "status").agg(F.count("*").alias("n"))


@query("l3_agree_split", f"""WITH {AGREE} SELECT fam AS grp, count_if(status='agree')::BIGINT AS agreed, count_if(status='disagree')::BIGINT AS ambiguous,
 count_if(status='disagree' AND second=gold)::BIGINT AS second_matches FROM j GROUP BY fam""")
def l3(spark, sf):
    return L.agree_split(agreed(spark, sf), "fam").withColumnRenamed("fam", "grp")


@query("l3_agreement_report", f"""WITH {AGREE}, t AS (SELECT gold, judge_label, count(*) AS n FROM j WHERE status='disagree' GROUP BY ALL ORDER BY n DESC, gold, judge_label LIMIT 15),
 m AS (SELECT gold, count(*) AS n FROM j WHERE status='agree' GROUP BY gold)
 SELECT 'status' AS what, status AS key, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'agree', fam||'/'||lang, count(*) FROM j WHERE status='agree' GROUP BY ALL
 UNION ALL SELECT 'agree_fam', fam, count(*) FROM j WHERE status='agree' GROUP BY ALL UNION ALL SELECT 'disagree_fam', fam, count(*) FROM j WHERE status='disagree' GROUP BY ALL
 UNION ALL SELECT 'agree_lang', lang, count(*) FROM j WHERE status='agree' GROUP BY ALL UNION ALL SELECT 'disagree_lang', lang, count(*) FROM j WHERE status='disagree' GROUP BY ALL
 UNION ALL SELECT 'label', 'min', min(n) FROM m UNION ALL SELECT 'label', 'max', max(n) FROM m UNION ALL SELECT 'disagreement', gold||'->'||judge_label, n FROM t""")
def l3_report(spark, sf):
    return L.agreement_report(agreed(spark, sf), ["fam", "lang"], "gold")


@query("l4_multilabel_gold", """WITH t AS (SELECT conv_id, turn, [role, 'long', 'short'] AS g,
 [CASE WHEN length(text)>200 THEN 'long' ELSE 'short' END, CASE WHEN role='user' THEN 'user' END] AS j FROM conversations),
 x AS (SELECT conv_id, turn, list_filter(g, lambda e: list_contains(j,e)) AS gold FROM t) SELECT conv_id, turn, array_to_string(gold,',') AS gold FROM x WHERE len(gold)>0""")
def l4(spark, sf):
    c = table(spark, sf, "conversations")
    size = F.when(F.length("text") > 200, "long").otherwise("short")
    df = c.select("conv_id", "turn", F.array("role", F.lit("long"), F.lit("short")).alias("g"),
                  F.array(size, F.when(F.col("role") == "user", F.lit("user"))).alias("j"))
    return L.multilabel_gold(df, "g", "j").select("conv_id", "turn", F.array_join("gold", ",").alias("gold"))


@query("l5_merge_judges", f"""WITH {ALPHA}, {BETA}, u AS (SELECT *, 0 AS prio FROM judge_beta UNION ALL SELECT *, 1 FROM judge_alpha WHERE judge_label=1)
 SELECT id, arg_max(judge,(prio,pos)) AS judge, arg_max(judge_label,(prio,pos))::INT AS judge_label FROM u GROUP BY id""")
def l5(spark, sf):
    return L.merge_judges([judge_log(spark, sf, "beta"), judge_log(spark, sf, "alpha").filter("judge_label = 1")], "id", "judge_label")


@query("l5_merge_judges_of", f"""WITH {ALPHA}, {BETA}, u AS (SELECT *, 0 AS prio FROM judge_beta UNION ALL SELECT *, 1 FROM judge_alpha WHERE judge_label=1),
 m AS (SELECT id, arg_max(judge,(prio,pos)) AS judge, arg_max(judge_label,(prio,pos)) AS judge_label FROM u GROUP BY id)
 SELECT d.source AS fam, judge, judge_label=1 AS positive, count(*) AS n FROM documents d LEFT JOIN m ON m.id=d.doc_id GROUP BY ALL""")
def l5_of(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("fam"))
    logs = [judge_log(spark, sf, "beta"), judge_log(spark, sf, "alpha").filter("judge_label = 1")]
    out = L.merge_judges_of(d, logs, "id", "judge_label", "fam")
    return out.groupBy("fam", "judge", (F.col("judge_label") == 1).alias("positive")).agg(F.count("*").alias("n"))


@query("l6_keep_first_partial", f"WITH {BETA} SELECT id, arg_min(judge_label,pos)::INT AS judge_label FROM judge_beta GROUP BY id")
def l6(spark, sf):
    return L.keep_first_partial(judge_log(spark, sf, "beta"), "id", ["pos"]).select("id", "judge_label")


@query("l7_batch_completeness", """SELECT doc_id//15 AS batch, count(*) AS asked, count(l.doc_id) AS answered, count(l.doc_id)>=count(*)*0.4 AS complete
 FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def l7(spark, sf):
    b = F.floor(F.col("doc_id") / 15).alias("batch")
    return L.batch_completeness(table(spark, sf, "documents").select(b), table(spark, sf, "labels").select(b), "batch", 0.4)


@query("l8_annotate_batches", """SELECT doc_id AS id, CASE WHEN length(text)>1500 THEN 'long' ELSE 'short' END AS label FROM documents""")
def l8(spark, sf):
    def down(texts):
        raise ConnectionError("no answer")

    def by_length(texts):
        return ["long" if len(t) > 1500 else "short" for t in texts]

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.annotate_batches(d, [down, by_length], 15).select("id", "label")


@query("l9_spot_check", "SELECT doc_id AS id, quality FROM labels ORDER BY md5(doc_id||'seed3'), doc_id LIMIT 30")
def l9(spark, sf):
    return L.spot_check(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", 30, "seed3")


@query("l10_agreement_by", f"""WITH {AGREE} SELECT coalesce(fam,'*') AS fam, coalesce(lang,'*') AS lang, count(*) AS judged, count_if(status='agree')::BIGINT AS agreed
 FROM j WHERE status<>'unjudged' GROUP BY CUBE(fam, lang)""")
def l10(spark, sf):
    return L.agreement_by(agreed(spark, sf).filter("status <> 'unjudged'"), ["fam", "lang"], F.col("status") == "agree")


# --- splits -------------------------------------------------------------------------------------


def emb(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")


def sql_rank(seed, by=""):
    part = f"PARTITION BY {by} " if by else ""
    over = f"OVER ({part}ORDER BY {sql_hint(f"'{seed}'||vec_id")}, vec_id)"
    size = f"OVER ({part})" if by else "OVER ()"
    return f"SELECT vec_id AS id, label, row_number() {over} AS rn, count(*) {size} AS size FROM embeddings"


@query("t1_hash_half_split", "SELECT doc_id AS id, CASE WHEN ('0x'||substr(md5('doc-'||doc_id),32,1))::INT%2=0 THEN 'train' ELSE 'test' END AS half FROM documents")
def t1(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return X.hash_half_split(d, F.concat(F.lit("doc-"), F.col("id")))


@query("t2_per_label_split", f"""WITH r AS ({sql_rank('t2', 'label')}) SELECT id, label, CASE WHEN rn<=round_even(0.6::DOUBLE*size,0) THEN 'train'
 WHEN rn<=round_even(0.8::DOUBLE*size,0) THEN 'dev' ELSE 'test' END AS part FROM r""")
def t2(spark, sf):
    return X.per_label_split(emb(spark, sf), "label", "id", {"train": 0.6, "dev": 0.2, "test": 0.2}, "t2")


@query("t3_leave_one_group_out", """SELECT vec_id AS id, f AS fold, CASE WHEN label=f THEN 'test' ELSE 'train' END AS role FROM embeddings, (SELECT unnest(range(10))::INT AS f)""")
def t3(spark, sf):
    return X.leave_one_group_out(emb(spark, sf), "label", LABELS).select("id", "fold", "role")


@query("t4_stratified_kfold", f"WITH r AS ({sql_rank('t4', 'label')}) SELECT id, label, (rn-1)%5 AS fold FROM r")
def t4(spark, sf):
    return X.stratified_kfold(emb(spark, sf), "label", "id", 5, "t4")


@query("t5_kfold", f"""WITH r AS ({sql_rank('t5')}) SELECT id, label, ntile(7) OVER (ORDER BY rn)-1 AS fold FROM r""")
def t5(spark, sf):
    return X.kfold(emb(spark, sf), "id", 7, "t5")


@query("t6_group_kfold", f"""WITH g AS (SELECT source, (row_number() OVER (ORDER BY {sql_hint("'t6'||source")}, source)-1)%5 AS fold FROM (SELECT DISTINCT source FROM documents))
 SELECT doc_id, source, fold FROM documents JOIN g USING (source)""")
def t6(spark, sf):
    return X.group_kfold(table(spark, sf, "documents").select("doc_id", "source"), "source", 5, "t6")


@query("t7_learning_curve_subsets", f"""WITH r AS ({sql_rank('t7')}) SELECT id, label, f AS frac FROM r, (SELECT unnest([0.25,0.5,0.75,1.0]::DOUBLE[]) AS f) WHERE rn<=round_even(f*size,0)""")
def t7(spark, sf):
    return X.learning_curve_subsets(emb(spark, sf), "id", [0.25, 0.5, 0.75, 1.0], "t7")


@query("t8_upweight", "SELECT doc_id, unnest(range(1,1+CASE WHEN quality=0 THEN 5 ELSE 1 END))::INT AS copy FROM labels")
def t8(spark, sf):
    return X.upweight(table(spark, sf, "labels").select("doc_id", "quality"), F.col("quality") == 0, 5).select("doc_id", "copy")


@query("t9_stride_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM labels) WHERE (rn-1)%4=0")
def t9(spark, sf):
    return X.stride_sample(table(spark, sf, "labels").select("doc_id"), "doc_id", 4)


@query("t10_groups_with_min", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*)>=20)")
def t10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    big = X.groups_with_min(d.join(table(spark, sf, "labels").select("doc_id"), "doc_id"), "source", 20)
    return d.join(big.select("source").distinct(), "source", "left_semi").select("doc_id", "source")


@query("t11_cross_source_split", """SELECT doc_id, d.dir AS direction, CASE WHEN lang=d.tr THEN 'train' ELSE 'test' END AS role FROM documents,
 (VALUES ('fr->de','fr'),('de->fr','de')) d(dir,tr) WHERE lang IN ('fr','de')""")
def t11(spark, sf):
    return X.cross_source_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "fr", "de").select("doc_id", "direction", "role")
