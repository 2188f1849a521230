"""Operator 13, k-d tree sharding: shards of nearly equal bytes whose rows lie close in their metadata.

The tree starts with all rows and all shards. A node with k > 1 shards is cut along its widest dimension (each
dimension scaled to its whole range, in 2^20 steps) where the bytes stand as k // 2 to the rest, until
every node is one shard. What is cut are atoms, in the order of the dimension, then digest, id and row: a group of
equal texts with at most 1/SHARE of a shard's bytes is one atom and stays whole, with the least metadata of its
rows; the rows of a larger group are atoms of their own and share shards only as far as bytes allow. An atom
goes to the side that holds its middle, so a cut is off by at most half an atom.

Weighted medians are exact and distributed. Each round sums bytes in BINS equal bins between the ends
of the part in which the median must lie, for all nodes of a level at once, and goes on inside the bin that holds it. A
round moves one row per node and bin; the driver sees one row per node, at most one per shard. Texts are read once; what is
shuffled afterwards are narrow rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import ordinal
from .common import stored

BINS = 4096
GRID = 2 ** 20 - 1  # largest coordinate of a scaled dimension
SHARE = 32  # a group of equal texts stays whole up to this part of a shard
KEYS = ["v", "digest", "tie", "row"]  # the order of atoms: coordinate, text, id, row


def dimension(df: DataFrame, name: str) -> Column:
    """A column as a number that keeps its order: strings by their first six bytes. Null, NaN and values
    beyond 1e300 have none."""
    kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    x = F.unix_micros(c.cast("timestamp")).cast("double") if kind in ("date", "timestamp") else c.cast("double")
    return F.when(F.abs(x) < 1e300, x)


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few rows of longs, known on the driver."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def atoms(docs: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """docs with their coordinates c0.., digest, tie, row and node (0), stored: equal keys are one atom."""
    spreads = [f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    whole = docs.agg(F.sum("size").alias("total"), *spreads).first()
    limit = (whole["total"] or 0) // (shards * SHARE)
    groups = docs.groupBy("digest").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"least_{d}") for d in dims])
    heavy = groups.filter(F.col("bytes") > limit).select("digest")  # fewer than shards * (SHARE + 1)
    light = docs.join(F.broadcast(heavy), "digest", "left_anti").join(groups.drop("bytes"), "digest")
    light = light.select("id", "size", "crc", "digest", F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("row"),
                         "place", *[F.col(f"least_{d}").alias(d) for d in dims])
    large = docs.join(F.broadcast(heavy), "digest", "left_semi").select(
        "id", "size", "crc", "digest", F.coalesce("id", F.lit(-1)).alias("tie"), F.col("place").alias("row"), "place", *dims)

    def scaled(d):
        low, high = whole[f"min_{d}"], whole[f"max_{d}"]
        if low is None or low == high:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(d) - F.lit(low)) / F.lit(high - low) * F.lit(float(GRID))), F.lit(0)).cast("long")

    rows = light.unionByName(large)
    return stored(rows.select("id", "size", "crc", "place", "digest", "tie", "row", F.lit(0).cast("long").alias("node"),
                              *[scaled(d).alias(f"c{i}") for i, d in enumerate(dims)]), "atoms")


def coordinate(n_dims: int) -> Column:
    return F.element_at(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), (F.col("dim") + 1).cast("int"))


def medians(rows: DataFrame, nodes: dict[int, dict], n_dims: int) -> None:
    """Finds for each node (dim, target) the atom in which the target-th byte of its order lies: adds its key `at`,
    the bytes before it and its own."""
    spark = rows.sparkSession
    for s in nodes.values():
        s.update(phase=0, at=[0] * len(KEYS), before=0, size=None)
    open_ = dict(nodes)
    while open_:
        state = [(n, s["dim"], s["phase"], *s["at"], s["lo"], s["hi"], (s["hi"] - s["lo"]) // BINS + 1, s["target"] - s["before"])
                 for n, s in open_.items()]
        small = literal_rows(spark, ["node", "dim", "phase", *[f"at_{k}" for k in KEYS], "lo", "hi", "step", "target"], state)
        met = rows.join(F.broadcast(small), "node").withColumn("v", coordinate(n_dims))
        inside, value = F.lit(False), F.col(KEYS[0])
        for p, key in enumerate(KEYS):
            same = F.lit(True)
            for q in KEYS[:p]:
                same = same & (F.col(q) == F.col(f"at_{q}"))
            inside = inside | ((F.col("phase") == p) & same & F.col(key).between(F.col("lo"), F.col("hi")))
            value = F.when(F.col("phase") == p, F.col(key)).otherwise(value)
        ends = [f(k).alias(f"{n}_{k}") for k in KEYS for f, n in ((F.min, "min"), (F.max, "max"))]
        bins = met.filter(inside).withColumn("bin", F.floor((value - F.col("lo")) / F.col("step"))).groupBy("node", "target", "bin").agg(
            F.sum("size").alias("w"), *ends)
        upto = F.sum("w").over(W.partitionBy("node").orderBy("bin"))
        hit = bins.withColumn("upto", upto).filter((F.col("upto") - F.col("w") <= F.col("target")) & (F.col("target") < F.col("upto")))
        for r in hit.collect():
            s = open_[r["node"]]
            s["before"] += r["upto"] - r["w"]
            while s["phase"] < len(KEYS) and r[f"min_{KEYS[s['phase']]}"] == r[f"max_{KEYS[s['phase']]}"]:
                s["at"][s["phase"]] = r[f"min_{KEYS[s['phase']]}"]
                s["phase"] += 1
            if s["phase"] == len(KEYS):
                s["size"] = r["w"]
                del open_[r["node"]]
            else:
                s["lo"], s["hi"] = r[f"min_{KEYS[s['phase']]}"], r[f"max_{KEYS[s['phase']]}"]


def kd_shards(df: DataFrame, row_id: str = "doc_id", text: str = "text", dims=("source", "lang", None, "doc_id"), shards: int = 40) -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: this law has none).

    size is the text's UTF-8 bytes and 16; a null text is empty. dims are metadata columns, strings, numbers or times; None
    stands for the size, and null metadata for the least. slot counts from 0 inside a shard in the order of the ids.
    Repeated rows and null ids are rows like others. Shards may be empty where there are fewer atoms; a text larger than a
    shard makes its shard larger. An empty table gives no rows.
    """
    spark = df.sparkSession
    names = [f"d{i}" for i in range(len(dims))]
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = (F.octet_length(text_) + 16).cast("long")
    docs = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), size.alias("size"),
                     F.crc32(text_.cast("binary")).alias("crc"),
                     F.conv(F.substring(F.sha2(text_, 256), 1, 15), 16, 10).cast("long").alias("digest"),
                     *[(size.cast("double") if d is None else dimension(df, d)).alias(n) for d, n in zip(dims, names)])
    docs = stored(docs.withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    rows = atoms(docs, names, shards)
    open_ = {0: shards}
    while active := {n: k for n, k in open_.items() if k > 1}:
        spans = [(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"span{i}") for i in range(len(dims))]
        lows = [f(f"c{i}").alias(f"{n}{i}") for i in range(len(dims)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        nodes, parts = {}, {}
        for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *spans, *lows).collect():
            k = active.get(r["node"])
            if k:
                dim = max(range(len(dims)), key=lambda i: (r[f"span{i}"], -i))
                nodes[r["node"]] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "target": r["w"] * (k // 2) // k}
                parts[r["node"]] = r["w"]
        if not nodes:
            break
        medians(rows, nodes, len(dims))
        cuts = []
        for n, s in nodes.items():
            k = active[n]
            left = 2 * k * s["before"] + k * s["size"] <= 2 * parts[n] * (k // 2)
            cuts.append((n, s["dim"], *s["at"][:-1], s["at"][-1] + left, n + k // 2))
        small = literal_rows(spark, ["node", "dim", *[f"at_{k}" for k in KEYS], "right"], cuts)
        less = F.lit(False)
        for key in reversed(KEYS):
            less = (F.col(key) < F.col(f"at_{key}")) | ((F.col(key) == F.col(f"at_{key}")) & less)
        rows = rows.join(F.broadcast(small), "node", "left").withColumn("v", coordinate(len(dims))).withColumn(
            "node", F.when(F.col("dim").isNull() | less, F.col("node")).otherwise(F.col("right"))).drop("dim", "v", "right", *[f"at_{k}" for k in KEYS])
        open_ = {m: c for n, k in active.items() for m, c in ((n, k // 2), (n + k // 2, k - k // 2))}
    placed = rows.select("id", "size", "crc", F.col("node").cast("int").alias("shard"), "place", F.coalesce("id", "place").alias("turn"))
    out = ordinal(placed, ["shard"], "turn", ["crc", "size", "place"], "slot")
    return out.select("id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                      (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
