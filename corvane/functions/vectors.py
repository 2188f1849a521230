"""Column helpers on array<float|double> vectors. Sums are taken in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(u: Column, v: Column) -> Column:
    prods = F.zip_with(u, v, lambda a, b: _double(a) * _double(b))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(u: Column, v: Column) -> Column:
    return dot(u, v) / (norm(u) * norm(v))


def l2_normalize(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: _double(x) / n))


def truncate_renorm(v: Column, d: int) -> Column:
    return l2_normalize(F.slice(v, 1, d))


def pair_features(u: Column, v: Column, blocks: str = "full") -> Column:
    """full = u, v, |u-v|, u*v; dp = |u-v|, u*v; pr = u*v; the dot product is appended to each."""
    diff = F.zip_with(u, v, lambda a, b: F.abs(_double(a) - _double(b)))
    prod = F.zip_with(u, v, lambda a, b: _double(a) * _double(b))
    parts = {"full": [u.cast("array<double>"), v.cast("array<double>"), diff, prod],
             "dp": [diff, prod], "pr": [prod]}[blocks]
    return F.concat(*parts, F.array(dot(u, v)))


def softmax(z: Column, temperature=1.0) -> Column:
    """Softmax of z/T, shifted by the maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))

    def total(e):
        return F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)

    def shifted(b):
        return F.transform(b["z"], lambda x: F.exp((x - b["top"]) / b["t"]))

    def scaled(e):
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    zs = let(z, lambda v: F.struct(v.alias("z"), F.array_max(v).alias("top"), t.alias("t")))
    return let(let(zs, shifted), scaled)
