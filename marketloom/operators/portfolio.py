"""Portfolio tables: allocation, correlation summaries, excess performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def allocation(holdings: DataFrame, sectors: DataFrame, unmapped: str = "unmapped") -> DataFrame:
    """``sector, value, weight``: normalised weights; symbols without a sector count as ``unmapped``.

    Sums come first, so the window without a key sees one row per sector.
    """
    by = holdings.join(sectors, "symbol", "left").groupBy(F.coalesce("sector", F.lit(unmapped)).alias("sector")).agg(F.sum("value").alias("value"))
    return by.withColumn("weight", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy())))


def correlations_of(pairs: DataFrame, symbol: str) -> DataFrame:
    """``symbol, corr``: one symbol with all others."""
    other = F.when(F.col("sym_i") == symbol, F.col("sym_j")).when(F.col("sym_j") == symbol, F.col("sym_i"))
    return pairs.select(other.alias("symbol"), "corr").where("symbol is not null")


def correlation_stats(pairs: DataFrame) -> DataFrame:
    """Summary over all off-diagonal cells (each pair twice, so the population deviation is that of the pairs)."""
    name = F.concat_ws("~", "sym_i", "sym_j")
    return pairs.agg(
        F.avg("corr").alias("mean"), F.percentile("corr", F.lit(0.5)).alias("median"), F.stddev_pop("corr").alias("std"), F.min("corr").alias("low"), F.max("corr").alias("high"),
        F.max_by(name, "corr").alias("highest"), F.min_by(name, "corr").alias("lowest"),
    )


def excess_performance(wide: DataFrame, periods: dict[str, int]) -> DataFrame:
    """``symbol, benchmark, period, excess`` from one column of returns for each period."""
    long = wide.select("symbol", F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.col(c).alias("value")) for c, n in periods.items()))).alias("p")).select("symbol", "p.*")
    other = long.select(F.col("symbol").alias("benchmark"), "period", F.col("value").alias("_b"))
    return long.join(other, "period").where("symbol <> benchmark").select("symbol", "benchmark", "period", (F.col("value") - F.col("_b")).alias("excess"))
