"""Hand-made rows for branches the given tables never reach."""

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import text as O


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.orderBy("i").select(expr.alias("o")).collect()]


def test_keys(spark):
    s = F.col("s")
    rows = ["你好，World_foo 123!", "ＡＢＣ１２３", "áb ²½", "", "  "]
    assert col(spark, rows, T.norm_key_nfkc(s)) == ["你好worldfoo123", "abc123", "áb212", "", ""]
    assert col(spark, rows, T.norm_key_plain(s))[0] == "你好world_foo123"


def test_script_and_declared_language(spark):
    s = F.col("s")
    assert col(spark, ["你好", "你好 ok", "你好 okay", "hello"], T.script_lang(s)) == ["zh", "zh", "mix", "en"]
    got = lambda d, t: col(spark, [t], T.resolve_lang(F.lit(d), s, "brand"))[0]
    assert got("zh", "plain text") == "en"
    assert got("en", "你好") == "mix"
    assert got("mix", "你好 Brand") == "zh"
    assert got("zh", "你好 one two three") == "mix"
    assert got("xx", "你好 one") == "mix"


def test_ngrams_count_characters_not_units(spark):
    s = F.col("s")
    assert col(spark, ["abcd", "ab", "😀😀a", ""], T.char_ngrams(s, 3)) == [["abc", "bcd"], ["ab"], ["😀😀a"], [""]]
    packed = col(spark, ["abcabc"], F.size(T.packed_ngrams(s, 3)))
    assert packed == [3]


def test_fullwidth(spark):
    assert col(spark, ["a b!~"], T.to_fullwidth(F.col("s"))) == ["ａ ｂ！～"]


def test_code_heavy_and_headings(spark):
    df = spark.createDataFrame([(1, "```\nx\n``` short"), (2, "```\nx\n```" + "p" * 200), (3, "no fence")], "id int, text string")
    assert sorted(r["id"] for r in O.drop_code_heavy(df, "text").collect()) == [2, 3]
    md = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\n## Three\nlast")], "id int, md string")
    rows = O.split_by_heading(md, "md", F.lit("file"), ["id"]).orderBy("section_no").collect()
    assert [(r["title"], r["body"]) for r in rows] == [("file", "intro"), ("One", "body"), ("Two", ""), ("Three", "last")]


def test_json_and_label_lists(spark):
    df = spark.createDataFrame([(1, 'Sure: {"k": 3} ok'), (2, "none"), (3, '{"k": ')], "id int, s string")
    assert {r["id"]: r["parsed"] and r["parsed"]["k"] for r in O.json_from_text(df, "s", "k int").collect()} == {1: 3, 2: None, 3: None}
    df = spark.createDataFrame([(1, '["A ", "b", "c"]'), (2, '{"labels": ["x", "Y"]}'), (3, '["a"]'), (4, "[broken")], "id int, s string")
    assert {r["id"]: r["labels"] for r in O.parse_label_list(df, "s", 2).collect()} == {1: ["a", "b"], 2: ["x", "y"], 3: None, 4: None}


def test_typo_changes_long_texts_only(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "abcdef", "sunshine"] * 20)], "id int, s string")
    rows = df.select("s", O.typo(F.col("s"), F.col("id"), "x").alias("t")).collect()
    assert all(r["t"] == r["s"] for r in rows if len(r["s"]) < 4)
    assert all(abs(len(r["t"]) - len(r["s"])) <= 1 for r in rows)
    assert {len(r["t"]) - len(r["s"]) for r in rows} == {-1, 0, 1}


def test_instruction_variants_reduce_texts_before_they_are_multiplied(spark):
    from corvane.operators.text import instruction_variants

    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "b|x"), (4, None), (5, ""), (None, "n")], "id long, text string")

    def rows(variants):
        return sorted(((r["key"], r["variant"], r["prompt"], r["id"]) for r in instruction_variants(df, "text", variants, ["id"]).collect()), key=str)

    assert rows({"a": "", "c": "Do"}) == sorted(
        [(f"a|{t}", "a", t, i) for t, i in (("x", 1), ("b|x", 2), ("", 5), ("n", None))] + [("a", "a", None, 4), ("c", "c", None, 4)]
        + [(f"c|{t}", "c", f"Instruct: Do\nQuery: {t}", i) for t, i in (("x", 1), ("b|x", 2), ("", 5), ("n", None))], key=str)
    # a|b and x, a and b|x: one key, and the least id stays
    assert [r for r in rows({"a": "", "a|b": ""}) if r[0] == "a|b|x"] == [("a|b|x", "a|b", "x", 1)]
    plan = instruction_variants(df, "text", {"a": "", "c": "Do"}, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the top of the plan comes first
