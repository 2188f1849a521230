"""Queries P1-P28: text keys, language tags, openers, parsers, perturbations, task grids."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import in_train_half
from ..functions.once import once
from ..functions.rules import is_correct
from ..operators import text as O
from .base import META, PREDS, items, preds, query, spread, sql_hint, sql_hunit, sql_key, sql_ok, table


def docs(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id").withColumnRenamed("doc_id", "id")


@query("p1_norm_key_nfkc", r"SELECT doc_id AS id, md5(regexp_replace(lower(text),'[^\p{L}\p{N}]+','','g')) AS key_md5 FROM documents")
def p1(spark, sf):
    return docs(spark, sf).select("id", F.md5(T.norm_key_nfkc(F.col("text"))).alias("key_md5"))


@query("p2_norm_key_plain", f"SELECT doc_id AS id, md5({sql_key('text')}) AS key_md5 FROM documents")
def p2(spark, sf):
    return docs(spark, sf).select("id", F.md5(T.norm_key_plain(F.col("text"))).alias("key_md5"))


# The tables hold no CJK text; accented letters are mapped to CJK to reach those branches.
ACCENTS, CJK_FOR = "éèüößä", "你好世界中文"
SQL_CJK = f"translate(text,'{ACCENTS}','{CJK_FOR}')"
SQL_HAS = r"regexp_matches({},'[\x{{4e00}}-\x{{9fff}}]')"


def _cjk(spark, sf):
    return docs(spark, sf).withColumn("text", F.translate("text", ACCENTS, CJK_FOR))


@query("p3_script_lang", f"""SELECT id, CASE WHEN {SQL_HAS.format('t')} AND regexp_matches(t,'[A-Za-z]{{3,}}') THEN 'mix'
 WHEN {SQL_HAS.format('t')} THEN 'zh' ELSE 'en' END AS tag FROM (SELECT doc_id AS id, {SQL_CJK} AS t FROM documents)""")
def p3(spark, sf):
    return _cjk(spark, sf).select("id", T.script_lang(F.col("text")).alias("tag"))


DECLARED = {"fr": "zh", "de": "mix", "es": "en", "en": "other"}


@query("p4_resolve_lang", f"""WITH a AS (SELECT doc_id AS id, {SQL_CJK} AS t, CASE lang WHEN 'fr' THEN 'zh' WHEN 'es' THEN 'en' ELSE 'mix' END AS d FROM documents),
 b AS (SELECT id, d, len(regexp_extract_all(t,'[\\x{{4e00}}-\\x{{9fff}}]')) AS c,
 len(list_filter(regexp_extract_all(t,'[A-Za-z]{{2,}}'), lambda w: lower(w)<>'die')) AS w FROM a)
 SELECT id, CASE WHEN c=0 THEN 'en' WHEN d='en' THEN 'mix' WHEN d='mix' AND w=0 THEN 'zh' WHEN d='zh' AND w>2 THEN 'mix' ELSE d END AS tag FROM b""")
def p4(spark, sf):
    declared = F.element_at(F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv]), F.col("lang"))
    return _cjk(spark, sf).select("id", T.resolve_lang(declared, F.col("text"), "die").alias("tag"))


@query("p5_cjk_ratio", f"""SELECT doc_id AS id, round(len(regexp_extract_all({SQL_CJK},'[\\x{{4e00}}-\\x{{9fff}}]'))::DOUBLE/greatest(1,length(text)),9) AS ratio,
 {SQL_HAS.format(SQL_CJK)} AS has FROM documents""")
def p5(spark, sf):
    return _cjk(spark, sf).select("id", F.round(T.cjk_ratio(F.col("text")), 9).alias("ratio"), T.has_cjk(F.col("text")).alias("has"))


@query("p6_split_composite_key", """SELECT doc_id AS id, source AS intent, CASE WHEN lang='en' THEN lang END AS confuser FROM documents""")
def p6(spark, sf):
    df = docs(spark, sf).select("id", F.concat_ws("|", "source", "lang").alias("key"),
                                F.when(F.col("lang") == "en", "hard").otherwise("label").alias("kind"))
    return O.split_composite_key(df, "key", "kind").select("id", "intent", "confuser")


def _log(spark, sf):
    """Documents as generation-log rows: one row per document with its lines as nested items."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x != "", F.struct(x.alias("text"), F.length(x).alias("n"))))
    return docs(spark, sf).select("id", lines.alias("items"))


@query("p7_explode_items", """SELECT id, item_no, md5(t) AS text_md5, length(t)::INT AS n FROM (
 SELECT doc_id AS id, unnest(string_split(text,chr(10))) AS t, (generate_subscripts(string_split(text,chr(10)),1)-1)::INT AS item_no FROM documents) WHERE t<>''""")
def p7(spark, sf):
    return O.explode_items(_log(spark, sf), "items", ["id"]).select("id", "item_no", F.md5("text").alias("text_md5"), "n")


@query("p8_min_length_filter", r"""SELECT id, length(t)::INT AS n FROM (SELECT doc_id AS id, trim(regexp_replace(text,'\n{3,}',chr(10)||chr(10),'g')) AS t FROM documents)
 WHERE length(t)>=150""")
def p8(spark, sf):
    return O.min_length_filter(docs(spark, sf), "text", 150, squeeze_newlines=True).select("id", F.length("text").alias("n"))


@query("p9_drop_code_heavy", r"""WITH m AS (SELECT doc_id AS id, CASE lang WHEN 'fr' THEN '```'||chr(10)||text||chr(10)||'```' WHEN 'de' THEN text||chr(10)||'```x```' ELSE text END AS t FROM documents)
 SELECT id FROM m WHERE NOT (len(regexp_extract_all(t,'```'))>=2 AND length(trim(regexp_replace(t,'(?s)```.*?```','','g')))<150)""")
def p9(spark, sf):
    fence = F.lit("```")
    t = F.when(F.col("lang") == "fr", F.concat(fence, F.lit("\n"), "text", F.lit("\n"), fence)).when(
        F.col("lang") == "de", F.concat("text", F.lit("\n```x```"))).otherwise(F.col("text"))
    return O.drop_code_heavy(docs(spark, sf).withColumn("text", t), "text").select("id")


@query("p10_split_by_heading", r"""WITH m AS (SELECT doc_id AS id, source, replace(replace(text,chr(10),chr(10)||'## '),'. ','.'||chr(10)) AS md FROM documents),
 s AS (SELECT id, source, string_split(regexp_replace(md,'(?m)^#{1,4} ',chr(1),'g'),chr(1)) AS ps FROM m),
 p AS (SELECT id, source, unnest(ps) AS part, (generate_subscripts(ps,1)-1)::INT AS section_no FROM s),
 b AS (SELECT id, section_no, CASE WHEN section_no=0 THEN source ELSE trim(split_part(part,chr(10),1)) END AS title,
  trim(CASE WHEN section_no=0 THEN part ELSE regexp_replace(part,'^[^\n]*\n?','') END, ' '||chr(10)) AS body FROM p)
 SELECT id, section_no, md5(title) AS title_md5, md5(substr(title||chr(10)||body,1,900)) AS text_md5 FROM b""")
def p10(spark, sf):
    md = F.replace(F.replace("text", F.lit("\n"), F.lit("\n## ")), F.lit(". "), F.lit(".\n"))
    df = docs(spark, sf).withColumn("md", md)
    return O.split_by_heading(df, "md", F.col("source"), ["id"]).select(
        "id", "section_no", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


@query("p11_valid_rows", """SELECT id, md5(t) AS text_md5 FROM (SELECT doc_id AS id, trim(text) AS t, lang FROM documents) WHERE lang IN ('en','fr') AND length(t)>=200""")
def p11(spark, sf):
    df = docs(spark, sf).withColumn("text", F.concat(F.when(F.col("lang") == "en", "EN: ").otherwise(""), F.col("text")))
    return O.valid_rows(df, "lang", ["en", "fr"], {"text": 200}).select("id", F.md5("text").alias("text_md5"))


@query("p12_json_from_text", "SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE (props->>'k')::INT END AS k FROM events")
def p12(spark, sf):
    cut = F.when(F.col("event_type") == "error", F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_id", F.concat(F.lit("Answer: "), cut, F.lit(" done.")).alias("said"))
    return O.json_from_text(df, "said", "k int").select("event_id", "parsed.k")


@query("p13_parse_label_list", """SELECT event_id, CASE event_type WHEN 'click' THEN 'click,click' WHEN 'view' THEN 'view,view' END AS labels FROM events""")
def p13(spark, sf):
    e = F.col("event_type")
    said = (F.when(e == "click", F.concat(F.lit('here: ["'), e, F.lit('", " '), F.upper(e), F.lit('", "extra"]')))
            .when(e == "view", F.concat(F.lit('{"labels": ["'), e, F.lit('", "'), e, F.lit('"]}')))
            .when(e == "error", F.lit('["only one"]')).otherwise(F.lit('["broken')))
    df = table(spark, sf, "events").select("event_id", said.alias("said"))
    return O.parse_label_list(df, "said", 2).select("event_id", F.array_join("labels", ",").alias("labels"))


@query("p14_align_batch", "SELECT conv_id, turn, role AS answer FROM conversations WHERE role<>'system'")
def p14(spark, sf):
    c = table(spark, sf, "conversations")
    answers = c.select("conv_id", F.when(F.col("role") == "system", F.col("turn") + 1000000).otherwise(F.col("turn")).alias("turn"),
                       F.col("role").alias("answer"))
    return O.align_batch(c.select("conv_id", "turn"), answers, "conv_id", "turn", "answer")


@query("p15_make_batches", """SELECT doc_id AS id, (rn-1)//15 AS batch, (rn-1)%15 AS pos FROM
 (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)""")
def p15(spark, sf):
    return O.make_batches(docs(spark, sf).select("id", "lang"), 15, "id", ["lang"]).select("id", "batch", "pos")


_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)
SQL_WIDE = "translate(text,'" + _PLAIN.replace("'", "''") + "','" + _WIDE + "')"


@query("p16_to_fullwidth", f"SELECT doc_id AS id, md5({SQL_WIDE}) AS text_md5 FROM documents")
def p16(spark, sf):
    return docs(spark, sf).select("id", F.md5(T.to_fullwidth(F.col("text"))).alias("text_md5"))


def sql_typo(s, k, seed):
    at, op = f"({sql_hint(f"'{seed}-at-'||{k}")}%(length({s})-2)+2)", f"({sql_hint(f"'{seed}-op-'||{k}")}%3)"
    return f"""CASE WHEN length({s})<4 THEN {s} WHEN {op}=0 THEN substr({s},1,{at}-1)||substr({s},{at}+1)
 WHEN {op}=1 THEN substr({s},1,{at})||substr({s},{at},1)||substr({s},{at}+1)
 ELSE substr({s},1,{at}-2)||substr({s},{at},1)||substr({s},{at}-1,1)||substr({s},{at}+1) END"""


@query("p17_typo", f"SELECT doc_id AS id, md5({sql_typo('text', 'doc_id', 's')}) AS text_md5 FROM documents")
def p17(spark, sf):
    return docs(spark, sf).select("id", F.md5(O.typo(F.col("text"), F.col("id"), "s")).alias("text_md5"))


PRE, SUF = ["please ", "hey, ", "urgent: "], [" thanks", "!!", " pls", "?"]


def sql_wrap(s, k, seed):
    return (f"({PRE!r}[{sql_hint(f"'{seed}-pre-'||{k}")}%{len(PRE)}+1]||{s}||{SUF!r}[{sql_hint(f"'{seed}-suf-'||{k}")}%{len(SUF)}+1])")


@query("p18_wrap", f"SELECT doc_id AS id, md5({sql_wrap('text', 'doc_id', 's')}) AS text_md5 FROM documents")
def p18(spark, sf):
    return docs(spark, sf).select("id", F.md5(O.wrap(F.col("text"), F.col("id"), PRE, SUF, "s")).alias("text_md5"))


@query("p19_perturb_set", f"""WITH d AS (SELECT doc_id::VARCHAR AS k, text, source FROM documents)
 SELECT k||'-ps' AS id, 'prefix_suffix' AS kind, source AS label, md5({sql_wrap('text', 'k', 's')}) AS text_md5 FROM d
 UNION ALL SELECT k||'-ty', 'typo', source, md5({sql_typo('text', 'k', 's')}) FROM d
 UNION ALL SELECT k||'-fw', 'fullwidth', source, md5({SQL_WIDE}) FROM d WHERE {sql_hunit("'s-fw-'||k")}<0.3
 UNION ALL SELECT 'odd-'||i, 'odd', 'unknown', md5(t) FROM (VALUES (0,''),(1,'   '),(2,'?'),(3,'1234567890')) o(i,t)""")
def p19(spark, sf):
    d = docs(spark, sf).select(F.col("id").cast("string").alias("id"), "text", F.col("source").alias("label"))
    odd = spark.createDataFrame(
        [(f"odd-{i}", t, "unknown", "odd") for i, t in enumerate(["", "   ", "?", "1234567890"])],
        "id string, text string, label string, kind string")
    return O.perturb_set(d, PRE, SUF, "s", 0.3, odd).select("id", "kind", "label", F.md5("text").alias("text_md5"))


@query("p20_instruction_variants", """WITH v(variant, ins) AS (VALUES ('bare',''),('cls','Classify the message'),('ret','Find related notes')),
 r AS (SELECT variant, doc_id AS id, variant||'|'||text AS key, CASE WHEN ins='' THEN text ELSE 'Instruct: '||ins||chr(10)||'Query: '||text END AS prompt FROM documents, v)
 SELECT md5(key) AS key_md5, any_value(variant) AS variant, min(id) AS id, md5(any_value(prompt)) AS prompt_md5 FROM r GROUP BY key""")
def p20(spark, sf):
    variants = {"bare": "", "cls": "Classify the message", "ret": "Find related notes"}
    return O.instruction_variants(docs(spark, sf), "text", variants, ["id"]).select(
        F.md5("key").alias("key_md5"), "variant", "id", F.md5("prompt").alias("prompt_md5"))


SQL_SQUEEZED = r"regexp_replace(lower(text),'\s+','','g')"


def sql_grams(s, n):
    return f"list_distinct(list_transform(range(1,greatest(1,length({s})-{n - 1})+1), lambda i: substr({s},i,{n})))"


@query("p21_char_ngrams", f"""SELECT id, len(g)::INT AS n_grams, md5(array_to_string(list_sort(g),'')) AS grams_md5 FROM
 (SELECT doc_id AS id, {sql_grams('s', 3)} AS g FROM (SELECT doc_id, {SQL_SQUEEZED} AS s FROM documents))""")
def p21(spark, sf):
    g = once(docs(spark, sf).select("id", T.squeezed(F.col("text")).alias("s")), g=T.char_ngrams(F.col("s"), 3))
    return g.select("id", F.size("g").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "")).alias("grams_md5"))


@query("p22_jaccard", f"""WITH g AS (SELECT doc_id AS id, {sql_grams('s', 2)} AS g FROM (SELECT doc_id, lower(text) AS s FROM documents))
 SELECT a.id, round(len(list_intersect(a.g,b.g))::DOUBLE/greatest(1,len(list_distinct(a.g||b.g))),9) AS jac FROM g a JOIN g b ON b.id=a.id+1""")
def p22(spark, sf):
    g = docs(spark, sf).select("id", T.char_ngrams(F.lower("text"), 2).alias("g"))
    nxt = g.select((F.col("id") - 1).alias("id"), F.col("g").alias("h"))
    return g.join(nxt, "id").select("id", F.round(T.jaccard(F.col("g"), F.col("h")), 9).alias("jac"))


@query("p23_hash_half", "SELECT doc_id AS id, ('0x'||substr(md5('doc-'||doc_id),32,1))::INT%2=0 AS train FROM documents")
def p23(spark, sf):
    return docs(spark, sf).select("id", in_train_half(F.concat(F.lit("doc-"), F.col("id"))).alias("train"))


TOOLS = [(label, f"tool{t}") for label in range(8) for t in sorted({label % 5, (label * 3 + 1) % 5})]
SQL_TOOLS = "tools(label, tool) AS (VALUES " + ",".join(f"({a},'{b}')" for a, b in TOOLS) + ")"


def tools(spark):
    """Labels 0-7 and their acceptable tools; 8 and 9 have none."""
    return spark.createDataFrame(TOOLS, "label int, tool string")


@query("p24_gold_tools", f"WITH {PREDS}, {SQL_TOOLS} SELECT id, p.label, tool FROM preds p JOIN tools t ON p.label=t.label")
def p24(spark, sf):
    return preds(spark, sf).select("id", "label").join(F.broadcast(tools(spark)), "label")


@query("p25_is_correct", f"WITH {PREDS} SELECT id, {sql_ok()} AS correct FROM preds")
def p25(spark, sf):
    return preds(spark, sf).select("id", is_correct(F.col("label"), F.col("pred"), META).alias("correct"))


SQL_TASKS = """tasks AS (SELECT 'label' AS kind, source AS key, unnest(range(CASE WHEN source='src0' THEN 6 ELSE 3 END))::INT AS rep FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT 'hard', source||'|'||lang, 0 FROM (SELECT DISTINCT source, lang FROM documents))"""


def tasks(spark, sf):
    d = table(spark, sf, "documents")
    labels = d.select(F.col("source").alias("label")).distinct()
    pairs = d.select(F.col("source").alias("label"), F.col("lang").alias("other")).distinct()
    return O.task_grid(labels, pairs, 3, "src0")


@query("p26_task_grid", f"WITH {SQL_TASKS} SELECT * FROM tasks")
def p26(spark, sf):
    return tasks(spark, sf)


PERSONAS, STYLES = ["student", "nurse", "driver"], ["short", "formal"]


@query("p27_render_prompt", f"""WITH {SQL_TASKS}, k AS (SELECT *, kind||'/'||key||'/'||rep AS k FROM tasks)
 SELECT kind, key, rep, {PERSONAS!r}[{sql_hint("'s-persona-'||k")}%3+1]||', '||{STYLES!r}[{sql_hint("'s-style-'||k")}%2+1]||': 9 zh, 7 mix, 4 en for '||key AS prompt FROM k""")
def p27(spark, sf):
    return O.render_prompt(tasks(spark, sf), PERSONAS, STYLES, 20, "s")


@query("p28_truncate", r"""SELECT doc_id AS id, md5(substr(text,1,420)) AS cut_md5, array_to_string(list_filter(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+'), lambda t: t<>'')[1:5],' ') AS head FROM documents""")
def p28(spark, sf):
    return docs(spark, sf).select("id", F.md5(T.truncate(F.col("text"), 420)).alias("cut_md5"),
                                  F.array_join(F.slice(T.tokens(F.col("text")), 1, 5), " ").alias("head"))
