"""Column helpers on text."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character ranges and word patterns the results depend on.
CJK = "[\\u4e00-\\u9fff]"
WORD3 = "[A-Za-z]{3,}"
WORD2 = "[A-Za-z]{2,}"
LANG_TAGS = ("zh", "mix", "en")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def norm_key_plain(s: Column) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", "")


def norm_key_nfkc(s: Column) -> Column:
    """Compatibility form, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(s)), r"[^\p{L}\p{N}]+", "")


def script_lang(s: Column) -> Column:
    return (
        F.when(s.rlike(CJK) & s.rlike(WORD3), "mix").when(s.rlike(CJK), "zh").otherwise("en")
    )


def resolve_lang(declared: Column, s: Column, stop_word: str) -> Column:
    """Keep the declared tag unless the script contradicts it; the first match wins."""
    d = F.when(declared.isin(*LANG_TAGS), declared).otherwise("mix")
    cjk = F.regexp_count(s, F.lit(CJK))
    words = F.size(
        F.filter(F.regexp_extract_all(s, F.lit(WORD2), F.lit(0)), lambda w: F.lower(w) != stop_word)
    )
    return (
        F.when(cjk == 0, "en")
        .when(d == "en", "mix")
        .when((d == "mix") & (words == 0), "zh")
        .when((d == "zh") & (words > 2), "mix")
        .otherwise(d)
    )


def cjk_ratio(s: Column) -> Column:
    return F.regexp_count(s, F.lit(CJK)) / F.greatest(F.lit(1), F.length(s))


def has_cjk(*texts: Column) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | t.rlike(CJK)
    return hit


def char_ngrams(s: Column, n: int) -> Column:
    """Distinct character n-grams; a text shorter than n gives itself as the only gram.

    One regular expression pass: at each character the look-ahead captures the n characters
    from there. Cutting by position would count from the start of the text for every gram.
    """
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


def packed_ngrams(s: Column, n: int) -> Column:
    """char_ngrams with each gram of up to three characters packed into one long, 21 bits a
    character: exact, and cheaper to sort, join and intersect than strings."""

    def pack(g):
        code = F.lit(0).cast("bigint")
        for i in range(n):
            code = code * (1 << 21) + F.ascii(F.substring(g, i + 1, 1))
        return code

    return F.transform(char_ngrams(s, n), pack) if n <= 3 else char_ngrams(s, n)


def squeezed(s: Column) -> Column:
    """Compatibility form, lower case, without white space: what n-grams are cut from."""
    return F.regexp_replace(F.lower(nfkc(s)), r"\s+", "")


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / F.greatest(F.lit(1), F.size(a) + F.size(b) - inter)


def to_fullwidth(s: Column) -> Column:
    """Printable ASCII (without the space) moved to its full-width form."""
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    return F.translate(s, plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))


def truncate(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def strip_lang_prefix(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?i)^\s*(zh|en|mix)\s*[:：]\s*", ""))


def tokens(s: Column) -> Column:
    """Lower-cased word tokens."""
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")
