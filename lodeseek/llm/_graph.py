"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of undirected edges (a, b) of longs.

    Returns a written table (node, root): root is the smallest node that can be reached;
    nodes without an edge to another are absent. Loops and repeated edges don't matter;
    no edges give an empty table. Each round is written to the shared folder; only a
    count and a checksum come to the driver. Rounds grow with the logarithm of the longest path.
    """
    cur = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    sign = None
    while True:
        new = materialise(_small(_large(cur)), label)
        # 32 bits of each hash: their sum can't overflow
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        discard(cur)
        cur = new
        if tuple(now) == sign:
            return _with_roots(cur)
        sign = tuple(now)


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _with_roots(stars: DataFrame) -> DataFrame:
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
