"""Seeded choices from md5, so that a draw depends only on the row's own key.

Spark recomputes lost partitions; a choice made from a hash of the key is the same
every time, which a random generator would not promise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 4294967296  # 2**32


def _text(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(*[c.cast("string") for c in cols])


def hash_int(*parts) -> Column:
    """First 32 bits of md5 over the concatenated parts, as a long in [0, 2**32)."""
    return F.conv(F.substring(F.md5(_text(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """The same as a double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(HASH_SPAN))


def hash_pick(options, *parts) -> Column:
    """One of the given literal options, chosen by hash."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.pmod(hash_int(*parts), F.lit(len(options))) + 1).cast("int"))


def in_train_half(key: Column) -> Column:
    """Parity of the md5 number: even goes to the train half (only the last digit matters)."""
    last = F.conv(F.substring(F.md5(key.cast("string")), 32, 1), 16, 10).cast("int")
    return last % 2 == 0
