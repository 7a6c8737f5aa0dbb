"""Connected components by alternating stars; no neighbourhood is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import staged


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
        F.coalesce(F.sum(F.xxhash64("v", "u") % 1_000_003), F.lit(0))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node it reaches.

    Large and small stars take turns until nothing changes; every node then hangs on its root.
    Edges from a node to itself are passed over.
    """
    edges = staged(edges.filter("u <> v").distinct(), "edges")
    seen = _print_of(edges)
    while True:
        edges = staged(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
