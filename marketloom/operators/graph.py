"""Graphs as vertex and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.staging import staged


def threshold_edges(pairs: DataFrame, least: float) -> DataFrame:
    """``a, b, weight``: pairs whose correlation is at least so strong, in either direction."""
    return pairs.where(F.abs("corr") >= least).select(F.col("sym_i").alias("a"), F.col("sym_j").alias("b"), F.col("corr").alias("weight"))


def sector_edges(members: DataFrame) -> DataFrame:
    """``node_i, node_j, sector``: pairs of nodes of one known sector."""
    known = members.where("sector is not null")
    other = known.select(F.col("node").alias("node_j"), "sector")
    return known.join(other, "sector").where("node < node_j").select(F.col("node").alias("node_i"), "node_j", "sector")


def adjacency(edges: DataFrame) -> DataFrame:
    """The symmetric matrix in long form."""
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))


def one_hot(nodes: DataFrame, category: str) -> DataFrame:
    """A 0/1 column for each value of a small category."""
    return nodes.groupBy("node").pivot(category).agg(F.lit(1)).fillna(0)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, degrees (positive weights only; population deviation) and density, in one row."""
    degree = adjacency(edges).where("weight > 0").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
    stats = nodes.join(degree, "node", "left").select(F.coalesce("d", F.lit(0)).alias("degree"))
    stats = stats.agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"), F.max("degree").alias("max_degree"))
    size = edges.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return stats.join(F.broadcast(size)).withColumn("density", F.try_divide(F.col("n_edges").cast("double"), possible))


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node with its edges, for export in parts."""
    out = adjacency(edges).groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list(F.struct("b", "weight"))).alias("edges"))
    return nodes.join(out, "node", "left").select(F.to_json(F.struct("node", "edges")).alias("value"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the least node that each node of ``links`` reaches.

    Each round, every node is tied to the least of its neighbours and itself,
    and so are its neighbours; rounds grow with the logarithm of the longest
    path. A round is a written table; a count and a hash of it reach the driver.
    """
    edges, before = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), None
    while True:
        edges = staged(edges, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        before = now
        both = edges.union(edges.select("b", "a")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        tied = both.join(least, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).union(least.select("low", "n"))
        edges = tied.where("a < b").distinct()
