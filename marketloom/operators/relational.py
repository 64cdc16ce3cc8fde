"""Joins, set operations and keyed upserts of the run store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which should be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert or update: of all rows of a key the newest stays, a change before what is stored."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def insert_or_ignore(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """What is stored stays; of new rows with an unknown key the first joins it."""
    fresh = first_by(changes.join(current.select(*keys), list(keys), "left_anti"), keys, order)
    return current.unionByName(fresh, allowMissingColumns=True)


def replace_by_key(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the keys that change go, the changes come."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def orphans(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows whose key none of the references has; null keys are orphans (unlike NOT IN)."""
    used = references[0].select(key)
    for other in references[1:]:
        used = used.union(other.select(key))
    return rows.join(used.distinct(), key, "left_anti")


def lookup_first(rows: DataFrame, facts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A correlated scalar subquery: the first value of the key by ``order``, or null."""
    return rows.join(facts.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")


def lookup_mean(rows: DataFrame, facts: DataFrame, key: str, value: str, default: float = 0.0) -> DataFrame:
    """A correlated scalar aggregate with a default."""
    means = facts.groupBy(key).agg(F.avg(value).alias(value))
    return rows.join(means, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def for_run(rows: DataFrame, run_id: str, column: str = "run_id") -> DataFrame:
    """Rows of a run, and those of none."""
    return rows.where((F.col(column) == run_id) | F.col(column).isNull())


def suffix_lookup(rows: DataFrame, domain: str, table: DataFrame, value: str, default) -> DataFrame:
    """The value of the longest suffix of a dotted name that a small table (``suffix``, value) lists.

    Every name is split into its own suffixes, so that the join is an equi-join.
    """
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    named = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = named.select("_row", F.explode(suffixes).alias("suffix")).join(table.select("suffix", value), "suffix")
    best = keys.groupBy("_row").agg(F.max_by(value, F.length("suffix")).alias(value))
    return named.join(best, "_row", "left").drop("_row").withColumn(value, F.coalesce(value, F.lit(default)))


def exact_greedy_match(current: DataFrame, prior: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pair rows one to one within a key, the n-th with the n-th; empty and null keys pair nothing.

    Taking the first free partner in order is the same as joining on the rank.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    usable = lambda df: df.where(" and ".join(f"{k} is not null and cast({k} as string) <> ''" for k in keys))
    a = usable(current).withColumn("nth", F.row_number().over(window))
    b = usable(prior).withColumn("nth", F.row_number().over(window)).select(*keys, "nth", F.col(order).alias(f"prior_{order}"))
    return a.join(b, [*keys, "nth"])


def best_candidate(current: DataFrame, prior: DataFrame, key: str, day: str, days: int, score) -> DataFrame:
    """For each current row the prior one of its key within so many days with the best ``score(current, prior)``.

    Ties go to the nearer, then to the smaller id. Days are joined as equal
    values of a short sequence, so no key is compared with all of its rows.
    """
    a = current.select(F.col("id").alias("cur_id"), key, F.col(day).alias("cur_day"), F.struct("*").alias("cur"))
    spread = prior.select(F.col("id").alias("prior_id"), key, F.col(day).alias("prior_day"), F.struct("*").alias("old"))
    spread = spread.select("*", F.explode(F.sequence(F.date_sub("prior_day", days), F.date_add("prior_day", days))).alias("cur_day"))
    pairs = a.join(spread, [key, "cur_day"]).withColumn("score", score(F.col("cur"), F.col("old")))
    rank = F.struct("score", -F.abs(F.datediff("cur_day", "prior_day")), -F.col("prior_id"))
    return pairs.groupBy("cur_id").agg(F.max_by("prior_id", rank).alias("prior_id"), F.max("score").alias("score"))
