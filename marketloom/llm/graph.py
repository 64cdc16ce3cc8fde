"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_groups, staged


def _pointed(edges: DataFrame, key: str, other: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``(edges with the least neighbour m of their key, the least neighbours alone)``."""
    low = staged(edges.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("degree")), "least-neighbours")
    return join_groups(edges, low, [key], "degree", [other], total).drop("degree"), low.drop("degree")


def _digest(edges: DataFrame) -> tuple:
    """The number of the distinct edges and a hash of them all."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``edges`` reaches.

    Large-star and small-star steps alternate: every node points its larger
    neighbours, then its smaller ones, at the smallest neighbour. The number of
    rounds grows with the logarithm of the longest path; nothing but a count
    and a hash of the edges reaches the driver, which ends when both stay; the
    edges of a star's centre are dealt over many tasks, and every round is a
    table in the shared folder. Ids must not be null; loops and repeated edges
    do no harm; no edges, no rows.
    """
    edges = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    now, before = _digest(edges), None
    while now != before:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met, low = _pointed(both, "a", "b", 2 * now[0])
        large = met.where("b > a").select(F.least("a", "m").alias("a"), "b").union(low.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        # b > a throughout: b points its smaller neighbours, and itself, at the smallest of them
        met, low = _pointed(staged(large, "large-star"), "b", "a", 2 * now[0])
        small = met.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).distinct()
        edges = staged(small, "small-star")
        now, before = _digest(edges), now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
