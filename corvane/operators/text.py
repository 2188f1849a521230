"""Filters, openers and generators over text tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import hash_int, hash_pick, hash_unit
from ..functions.ranking import ordinal


def split_composite_key(df: DataFrame, key: str, kind: str) -> DataFrame:
    """`a|b` gives intent a; b is the confuser for hard rows only."""
    parts = F.split(key, r"\|")
    return df.withColumn("intent", F.element_at(parts, 1)).withColumn(
        "confuser", F.when(F.col(kind) == "hard", F.try_element_at(parts, F.lit(2)))
    )


def explode_items(df: DataFrame, items: str, keep: list[str]) -> DataFrame:
    """One row per element of an array of structs with its ordinal; rows whose array is
    missing and elements that are null give nothing."""
    return (
        df.select(*keep, F.posexplode(items).alias("item_no", "item"))
        .filter(F.col("item").isNotNull())
        .select(*keep, "item_no", "item.*")
    )


def min_length_filter(df: DataFrame, col: str, n: int, squeeze_newlines: bool = False) -> DataFrame:
    text = F.trim(F.regexp_replace(col, r"\n{3,}", "\n\n")) if squeeze_newlines else F.trim(col)
    return df.withColumn(col, text).filter(F.length(col) >= n)


def drop_code_heavy(df: DataFrame, col: str, min_prose: int = 150, min_fences: int = 2) -> DataFrame:
    """Drops texts with fenced blocks and little prose outside them."""
    prose = F.length(F.trim(F.regexp_replace(col, r"(?s)```.*?```", "")))
    fences = F.regexp_count(col, F.lit("```"))
    return df.filter(~((fences >= min_fences) & (prose < min_prose)))


def split_by_heading(df: DataFrame, body: str, fallback: Column, keep: list[str], cut: int = 900):
    """Sections of a Markdown text. A section's first line is its title; the part before
    the first heading takes the fallback title."""
    marked = F.regexp_replace(body, r"(?m)^#{1,4} ", "\u0001")
    parts = F.posexplode(F.split(marked, "\u0001"))
    titled = df.select(*keep, fallback.alias("_fallback"), parts.alias("section_no", "_part")).select(
        *keep, "section_no",
        F.when(F.col("section_no") == 0, F.col("_fallback"))
        .otherwise(F.trim(F.substring_index("_part", "\n", 1))).alias("title"),
        F.trim(
            F.when(F.col("section_no") == 0, F.col("_part")).otherwise(
                F.regexp_replace("_part", r"^[^\n]*\n?", "")
            ), F.lit(" \n")
        ).alias("body"),
    )
    return titled.withColumn("text", F.substring(F.concat_ws("\n", "title", "body"), 1, cut))


def valid_rows(df: DataFrame, label: str, allowed: list, min_len: dict[str, int]) -> DataFrame:
    """Label whitelist and least trimmed lengths, after a leading language tag is cut."""
    for c in min_len:
        df = df.withColumn(c, T.strip_lang_prefix(F.col(c)))
    cond = F.col(label).isin(*allowed)
    for c, n in min_len.items():
        cond = cond & (F.length(c) >= n)
    return df.filter(cond)


def json_from_text(df: DataFrame, col: str, schema: str, out: str = "parsed") -> DataFrame:
    """Parses the first object or list inside free text; null where there is none that parses."""
    span = F.regexp_extract(col, r"(?s)(\{.*\}|\[.*\])", 1)
    return df.withColumn(out, F.from_json(F.nullif(span, F.lit("")), schema))


def parse_label_list(df: DataFrame, col: str, n: int, out: str = "labels") -> DataFrame:
    """A bare list of labels, or an object holding one, cut to n and tidied; rows with
    another length get null."""
    bare = F.from_json(F.regexp_extract(col, r"(?s)(\[.*\])", 1), "array<string>")
    obj = F.from_json(F.regexp_extract(col, r"(?s)(\{.*\})", 1), "labels array<string>")["labels"]
    tidy = F.transform(F.slice(F.coalesce(obj, bare), 1, n), lambda x: F.lower(F.trim(x)))
    return df.withColumn(out, F.when(F.size(tidy) == n, tidy))


def align_batch(items: DataFrame, answers: DataFrame, batch: str, pos: str, answer: str) -> DataFrame:
    """Answers matched to their items by (batch, returned index); indices outside the
    batch find no item and fall away."""
    return items.join(answers.select(batch, pos, answer), [batch, pos])


def align_by_position(df: DataFrame, items: str, labels: str, keep: list[str]) -> DataFrame:
    """Pairs two arrays element by element where their lengths agree."""
    zipped = F.arrays_zip(F.col(items).alias("item"), F.col(labels).alias("label"))
    return (
        df.filter(F.size(items) == F.size(labels))
        .select(*keep, F.posexplode(zipped).alias("pos", "p"))
        .select(*keep, "pos", "p.item", "p.label")
    )


def make_batches(df: DataFrame, n: int, order: str, by=()) -> DataFrame:
    """Consecutive batches of n rows, inside each group."""
    return ordinal(df, by, order, out="_rn").withColumn(
        "batch", F.floor((F.col("_rn") - 1) / n).cast("bigint")
    ).withColumn("pos", ((F.col("_rn") - 1) % n).cast("bigint")).drop("_rn")


def typo(s: Column, key: Column, seed: str) -> Column:
    """Drops, doubles or swaps one inner character of texts of four or more."""
    at = (F.pmod(hash_int(seed, "-at-", key), F.length(s) - 2) + 2).cast("int")
    head, ch = F.substring(s, F.lit(1), at - 1), F.substring(s, at, F.lit(1))
    tail = F.substring(s, at + 1, F.length(s))
    prev = F.substring(s, at - 1, F.lit(1))
    op = F.pmod(hash_int(seed, "-op-", key), F.lit(3))
    changed = (
        F.when(op == 0, F.concat(head, tail))
        .when(op == 1, F.concat(head, ch, ch, tail))
        .otherwise(F.concat(F.substring(s, F.lit(1), at - 2), ch, prev, tail))
    )
    return F.when(F.length(s) < 4, s).otherwise(changed)


def wrap(s: Column, key: Column, prefixes: list[str], suffixes: list[str], seed: str) -> Column:
    return F.concat(
        hash_pick(prefixes, seed, "-pre-", key), s, hash_pick(suffixes, seed, "-suf-", key)
    )


def perturb_set(df: DataFrame, prefixes, suffixes, seed: str, wide_share: float = 0.3, odd: DataFrame | None = None):
    """Every row wrapped and with a typo, a hashed share in full width, and given odd rows.
    The input is (id string, text, label); ids get a suffix naming the change."""
    key = F.col("id")
    forms = F.array(
        F.struct(F.lit("ps").alias("sfx"), F.lit("prefix_suffix").alias("kind"),
                 wrap(F.col("text"), key, prefixes, suffixes, seed).alias("t")),
        F.struct(F.lit("ty").alias("sfx"), F.lit("typo").alias("kind"),
                 typo(F.col("text"), key, seed).alias("t")),
        F.struct(F.lit("fw").alias("sfx"), F.lit("fullwidth").alias("kind"),
                 F.when(hash_unit(seed, "-fw-", key) < wide_share, T.to_fullwidth(F.col("text"))).alias("t")),
    )
    out = df.select("id", "label", F.explode(forms).alias("f")).filter("f.t is not null").select(
        F.concat_ws("-", "id", "f.sfx").alias("id"), F.col("f.t").alias("text"), "label",
        F.col("f.kind").alias("kind"),
    )
    return out if odd is None else out.unionByName(odd)


def instruction_variants(df: DataFrame, text: str, variants: dict[str, str], keep: list[str]) -> DataFrame:
    """Each text under each instruction; the first of equal keys is kept. An empty
    instruction leaves the text bare.

    Equal texts are reduced to the first before the variants are made, by their digest, so that what is sorted holds each text
    once and not six times. Only where a name goes on another name and the bar can keys of different texts be equal; then
    the variants are reduced as well.
    """

    def firsts(rows, value):
        order = F.struct(F.col(keep[0]).isNull(), keep[0])
        return rows.groupBy(F.sha2(value, 256)).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")

    texts = firsts(df.select(text, *keep), text)
    grid = F.array(*[
        F.struct(F.lit(name).alias("variant"),
                 (F.concat(F.lit(f"Instruct: {ins}\nQuery: "), F.col(text)) if ins else F.col(text)).alias("prompt"))
        for name, ins in variants.items()
    ])
    rows = texts.select(*keep, text, F.explode(grid).alias("v")).select(
        F.concat_ws("|", "v.variant", text).alias("key"), "v.variant", "v.prompt", *keep
    )
    if any(a != b and b.startswith(f"{a}|") for a in variants for b in variants):
        rows = firsts(rows, "key")
    return rows


def task_grid(labels: DataFrame, pairs: DataFrame, reps: int, doubled) -> DataFrame:
    """A task per label and repetition (twice as many for one label), and per hard pair."""
    times = F.when(F.col("label") == F.lit(doubled), reps * 2).otherwise(reps)
    easy = labels.select(
        F.lit("label").alias("kind"), F.col("label").cast("string").alias("key"),
        F.explode(F.sequence(F.lit(0), times - 1)).alias("rep"),
    )
    hard = pairs.select(
        F.lit("hard").alias("kind"), F.concat_ws("|", "label", "other").alias("key"), F.lit(0).alias("rep")
    )
    return easy.unionByName(hard)


def render_prompt(df: DataFrame, personas: list[str], styles: list[str], n: int, seed: str) -> DataFrame:
    """Hash-chosen persona and style, and the language quotas 45 % / 35 % / rest of n."""
    key = F.concat_ws("/", "kind", "key", "rep")
    zh, mix = round(0.45 * n), round(0.35 * n)
    return df.select(
        "kind", "key", "rep",
        F.format_string(
            f"%s, %s: {zh} zh, {mix} mix, {n - zh - mix} en for %s",
            hash_pick(personas, seed, "-persona-", key), hash_pick(styles, seed, "-style-", key), F.col("key"),
        ).alias("prompt"),
    )
