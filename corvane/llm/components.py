"""Connected components of a link table by alternating star contractions.

Each round hangs every neighbour under the least neighbour of its node, first the larger ones
(large star), then the smaller ones (small star), until nothing changes. A round is two partial
aggregations and two joins on the node, written to the shared folder; the driver only sees two
numbers. Chains shorten in logarithmically many rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for every node that has a link to another node.
    Null ends and links of a node to itself are ignored, repeated links count once."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.filter(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    seen = None
    while True:
        mark = _mark(edges)
        if mark == seen or mark["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
        seen = mark
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # large star: all neighbours of u that are larger than u go under the least of u's neighbours
        roots = least.unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("m"))).groupBy("u").agg(F.min("m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(roots, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: u and its smaller neighbours go under the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        edges = stored(hung.filter("u != v").distinct(), "edges")
