"""Operator 5, secret scans weighed by corpus-wide ownership.

Candidates come from patterns. Each candidate's value is hashed, and the hashes are counted over
the whole corpus by distinct repositories and owners: a value that several owners carry is a copied
example, one that stays with its owner and looks like a key is taken to be live. Long runs of
letters and digits that no pattern names are added as spans of kind `owned` when their value
belongs to fewer owners than make an example.

Everything is DataFrame functions. Spark has no function for the places of matches, so they are
summed from the pieces between matches (`split`) and the matches (`regexp_extract_all`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import let
from .common import stored

# The base patterns. `hex` and `access` carry their least length in the pattern: runs
# are maximal, so this drops exactly the matches that are too short.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "owned"]
OWNED = r"[A-Za-z0-9_-]{20,}"
STEP = 256  # matches whose lengths are summed as one, so that places take no quadratic time
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Start, kind, end and value of every match, in order; places in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), values.alias("value"))

    def total(lengths):
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + n)

    def measured(r):
        return F.struct(r.alias("rows"), F.transform(r, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long")).alias("n"))

    def summed(m):
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(m["n"]) - 1) / STEP).cast("int")))
        return F.struct(m["rows"].alias("rows"), m["n"].alias("n"), F.transform(blocks, lambda b: total(F.slice(m["n"], b * STEP + 1, STEP))).alias("sums"))

    def placed(m):
        def span(row, i):
            block = F.floor(i / STEP).cast("int")
            start = total(F.slice(m["sums"], F.lit(1), block)) + total(F.slice(m["n"], block * STEP + 1, i % STEP)) + F.length(row["gap"])
            end = start + F.length(row["hit"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value"))

        return F.filter(F.transform(m["rows"], span), lambda s: s["end"].isNotNull())

    found = let(let(let(rows, measured), summed), placed).cast(SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(
        F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def candidates(df: DataFrame, row_id: str, text: str, repo: Column, owner: Column) -> DataFrame:
    """One row per input row: id, _h (hash of the text), repo, owner, base and owned spans. Written once,
    as the patterns are the costly part and three later steps need the spans."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{row_id}`").alias("id"), repo.alias("repo"), owner.alias("owner"), t.alias("_t"))
    assign = F.filter(_spans(F.col("_t"), ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 6)
    base = F.concat(assign, _spans(F.col("_t"), ACCESS, 1), _spans(F.col("_t"), HEX, 2))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    owned = F.filter(_spans(F.col("_t"), OWNED, 3), mixed)
    return stored(docs.select("id", F.xxhash64("_t", F.length("_t")).alias("_h"), "repo", "owner", base.alias("base"),
                              owned.alias("owned")), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners. Distinct (hash, repository, owner) triples are made first, by partial
    aggregation, so a value on a third of all rows is one row per repository when it is counted."""
    one = found.select("repo", "owner", F.explode(F.concat("base", "owned")).alias("s")).select(
        F.sha2("s.value", 256).alias("value_hash"), "repo", "owner")
    triples = one.groupBy("value_hash", "repo", "owner").agg(F.count("*").alias("rows"))
    return triples.groupBy("value_hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"),
                                             F.sum("rows").alias("n_rows"))


def classified(found: DataFrame, copied: int = 3, salts: int = 16) -> DataFrame:
    """One row per (id, text) with candidates: id, _h, spans (array of span with its value and `example`,
    true where `copied` or more owners carry the value). Null owners and repositories count as
    none, so a value seen only without an owner is no example. The counts are repeated over
    `salts`, so a value on very many rows is joined in many tasks."""
    owners = ownership(found).select("value_hash", (F.col("n_owners") >= copied).alias("example"),
                                     F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = found.select("id", "_h", F.explode(F.concat("base", "owned")).alias("s")).withColumn(
        "value_hash", F.sha2("s.value", 256)).withColumn("salt", F.pmod(F.xxhash64("id", "_h"), F.lit(salts)).cast("int"))
    met = rows.join(owners, ["value_hash", "salt"])
    span = F.struct("s.start", "s.kind", "s.end", "s.value", "example")
    return met.groupBy("id", "_h").agg(F.collect_set(span).alias("spans"))


def _live(s) -> Column:
    return ~s["example"] & (F.length(s["value"]) >= 12) & s["value"].rlike("[0-9]")


def scan(df: DataFrame, row_id: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None,
         copied: int = 3) -> DataFrame:
    """One row per input row: id, base (spans of the fixed patterns), spans (those and the added ones),
    n_example and n_live: spans whose value is widely copied, and spans that stay with few owners
    and look like a key. repo and owner default to source/lang and source.

    A null text is empty and has no spans. Rows with equal id and text have equal results; null ids
    are kept. An empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = candidates(df, row_id, text, repo, owner)
    marks = classified(found.filter(F.size("base") + F.size("owned") > 0), copied).select(
        F.col("id").alias("_id"), F.col("_h").alias("_g"), "spans")
    rows = found.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long,value:string,example:boolean>>"))
    added = F.transform(F.filter(spans, lambda s: (s["kind"] == 3) & ~s["example"]),
                        lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    return rows.select("id", "base", F.concat("base", added.cast(SPAN)).alias("spans"),
                       F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_example"),
                       F.size(F.filter(spans, _live)).cast("long").alias("n_live"))


def span_text(spans: str) -> Column:
    return _text_of(F.col(spans))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, row_id: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None,
           copied: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """The rows as they are, with secrets replaced by `mark` in their texts: every value that a fixed pattern
    names, however short and with or without digits, and added ones that look like a key; copied
    examples stay. An assigned value that does not look like a key is replaced where it is assigned, any
    other wherever it stands. Texts without such a secret, null ones too, are left as they are."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = candidates(df, row_id, text, repo, owner).filter(F.size("base") + F.size("owned") > 0)
    long = lambda s: _live(s) | (~s["example"] & s["kind"].isin(1, 2))
    live = F.array_distinct(F.transform(F.filter("spans", long), lambda s: s["value"]))
    longest = F.array_sort(live, lambda a, b: F.length(b) - F.length(a))
    here = F.filter("spans", lambda s: ~s["example"] & (s["kind"] == 0) & ~_live(s))
    places = F.reverse(F.array_sort(F.transform(here, lambda s: F.struct(
        (s["end"] - F.length(s["value"])).cast("int").alias("at"), F.length(s["value"]).alias("n")))))  # the last first
    marks = classified(found, copied).select(
        F.col("id").alias("__secret_id"), F.col("_h").alias("__secret_h"), longest.alias("__secret_values"),
        places.alias("__secret_places")).filter((F.size("__secret_values") > 0) | (F.size("__secret_places") > 0))
    t = F.col(f"`{text}`")
    keyed = df.withColumn("__secret_t", F.xxhash64(F.coalesce(t, F.lit("")), F.length(F.coalesce(t, F.lit("")))))
    met = keyed.join(marks, F.col(f"`{row_id}`").eqNullSafe(F.col("__secret_id")) & (F.col("__secret_t") == F.col("__secret_h")), "left")
    clean = F.when(F.col("__secret_values").isNull(), t).otherwise(
        F.aggregate("__secret_values", F.aggregate("__secret_places", t, lambda acc, s: F.overlay(acc, F.lit(mark), s["at"] + 1, s["n"])),
                    lambda acc, v: F.replace(acc, v, F.lit(mark))))
    return met.withColumn(text, clean).drop("__secret_id", "__secret_h", "__secret_t", "__secret_values", "__secret_places")
