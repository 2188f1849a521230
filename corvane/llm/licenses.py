"""Operator 1, licence scans as an exact set-similarity join of text blocks and licence templates.

A block matches a template when it holds at least ceil(threshold * |T|) of the template's |T| distinct
words. Blocks are lines and, for notices wrapped over lines, all stretches of as many words as the
template has; the latter are cut only from texts that pass the same filters as a whole. Template words have one global order, rare in the corpus first. A match must
hold one of the template's |T| - o + 1 rarest words (prefix), at least o template words at all
(length), and after the first shared word enough words on either side to reach o (position); the
join runs over those prefix words and the few pairs left are verified by intersection.

Everything is DataFrame functions. The template side is a fixed list given by the caller, so it is
broadcast; only its words' counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once

# The phrases of the base scan and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Notices of common licences, by label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]


def spaced(text: Column) -> Column:
    """' w1  w2  w3 ': the words of a text, A-Z lower-cased, each between single spaces, so that a
    phrase in the same form is found by plain search; '' without words.

    `lower` also changes letters beyond A-Z, which stay letters beyond ASCII and so leave words and
    matches as they are; the Kelvin sign, the only one that becomes an ASCII letter, is put aside
    first. (A capital I with a dot becomes i and a combining dot: not an ASCII word either.)
    """
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5")))
    words = F.trim(F.regexp_replace(low, DELIMITERS, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def word_count(s: Column) -> Column:
    return F.when(s == "", F.lit(0).cast("long")).otherwise(_count(s, "  ") + 1)


def _phrases(rows: DataFrame, phrases) -> DataFrame:
    """n_words, n_base, first_word, last_word and base (array of labels) from column `_s`."""
    s, n, firsts, lasts, labels = F.col("_s"), [], [], [], []
    for phrase, label in phrases:
        words = phrase.split()
        form = " " + "  ".join(words) + " "
        found = F.contains(s, F.lit(form))
        n.append(F.when(found, _count(s, form)).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(found, word_count(F.substring_index(s, form, 1))))
        lasts.append(F.when(found, word_count(s) - word_count(F.substring_index(s, form, -1)) - len(words)))
        labels.append(F.when(found, F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    least = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    most = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
    return rows.select("id", "_h", word_count(s).alias("n_words"), total.alias("n_base"), least.alias("first_word"),
                       most.alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def _wrapped(docs: DataFrame, ordered: Column, prefixes: DataFrame, fewest: int) -> DataFrame:
    """id, _h, label, share of the templates that a stretch of their length in the words `w` matches."""
    held = once(docs, held=F.array_intersect(ordered, "w")).filter(F.size("held") >= fewest)
    both = F.array_intersect("held", "all")
    near = held.withColumn("word", F.explode("held")).join(prefixes, "word").withColumn("both", both).filter(
        (F.col("both")[0] == F.col("word")) & (F.size("both") >= F.col("least")))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_contains("all", F.element_at("w", i)))
    most = F.aggregate(starts, F.lit(0), lambda acc, i: F.greatest(acc, F.size(F.array_intersect(F.slice("w", i, F.col("span")), F.col("all")))))
    return near.withColumn("most", most).filter(F.col("most") >= F.col("least")).select(
        "id", "_h", "label", (F.col("most") / F.size("all")).alias("share"))


def scan(df: DataFrame, row_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES,
         num: int = 8, den: int = 10) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A template matches a line, or a stretch of its own length over lines, that holds at least num/den of
    its distinct words. score is the
    greatest share of a template that a matching block holds, 1 where a phrase stands, else 0.
    A null text is empty: no words, no labels, null places. Rows with equal id and text have equal
    results; null ids are kept. Template words count once however often they repeat.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{row_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    docs = docs.withColumn("_h", F.xxhash64("_t", F.length("_t")))

    given = [(label, sorted(set(t.replace(".", " ").lower().split()))) for label, t in templates]
    spans = {(label, tuple(ws)): len(t.replace(".", " ").split()) for (label, ws), (_, t) in zip(given, templates)}
    vocabulary = sorted({w for _, ws in given for w in ws})
    listed = F.array(*[F.lit(w) for w in vocabulary])
    words = F.split(F.trim(spaced(F.col("_t"))), "  ")
    seen = docs.select(F.explode(F.array_intersect(listed, words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r.word: r.n for r in seen.collect()}  # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    made = []
    for label, ws in given:
        ws = sorted(ws, key=rank.__getitem__)
        least = -(-len(ws) * num // den)
        made += [F.struct(F.lit(label).alias("label"), F.lit(w).alias("word"), F.lit(p).alias("place"), F.lit(least).alias("least"), F.lit(spans[label, tuple(sorted(ws))]).alias("span"),
                          F.array(*[F.lit(x) for x in ws]).alias("all")) for p, w in enumerate(ws[:len(ws) - least + 1])]
    prefixes = F.broadcast(spark.range(1).select(F.inline(F.array(*made))))
    fewest = min(-(-len(ws) * num // den) for _, ws in given)

    ordered = F.array(*[F.lit(w) for w in order])
    lines = docs.select("id", "_h", F.explode(F.split("_t", "\n")).alias("line"))
    held = once(lines, held=F.array_intersect(ordered, F.split(F.trim(spaced(F.col("line"))), "  "))).drop("line")
    held = held.filter(F.size("held") >= fewest)
    at = held.select("id", "_h", "held", F.posexplode("held").alias("at", "word"))
    met = at.join(prefixes, "word").filter(F.size("held") >= F.col("least")).filter(
        1 + F.least(F.size("all") - F.col("place"), F.size("held") - F.col("at")) - 1 >= F.col("least"))
    both = F.array_intersect("held", "all")
    met = met.withColumn("both", both).filter((F.col("both")[0] == F.col("word")) & (F.size("both") >= F.col("least")))
    met = met.select("id", "_h", "label", (F.size("both") / F.size("all")).alias("share")).unionByName(
        _wrapped(once(docs.filter(F.contains("_t", F.lit("\n"))), w=words).drop("_t"), ordered, prefixes, fewest))
    found = met.groupBy("id", "_h").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    base = _phrases(docs.select("id", "_h", spaced(F.col("_t")).alias("_s")), phrases)
    found = found.select(F.col("id").alias("_id"), F.col("_h").alias("_g"), "found", "share")
    rows = base.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return rows.select(
        "id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
