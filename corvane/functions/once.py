"""Columns computed once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns whose value is computed once however often it is used later.

    Spark merges neighbouring projections, so a column made from a costly expression is
    computed again at each use, and inside a lambda again for each element. A generator in
    between keeps the projections apart without a shuffle.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, made.alias("_once")).select(*keep, "_once.*")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, for use inside expressions with lambdas."""
    return F.transform(F.array(value), body)[0]
