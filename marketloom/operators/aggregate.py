"""Report aggregations: shares, coverage, experiments, audits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


# The least users of a variation, the effect that is stated where nothing can be tested, and the published coefficients of the error function and of the normal distribution's inverse.
MIN_SAMPLE, NO_TEST_MDE = 100, 0.05
ERF_SERIES = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
ACKLAM_A = [2.506628277459239e00, -3.066479806614716e01, 1.383577518672690e02, -2.759285104469687e02, 2.209460984245205e02, -3.969683028665376e01]
ACKLAM_B = [-1.328068155288572e01, 6.680131188771972e01, -1.556989798598866e02, 1.615858368580409e02, -5.447609879822406e01]
ACKLAM_C = [2.938163982698783e00, 4.374664141464968e00, -2.549732539343734e00, -2.400758277161838e00, -3.223964580411365e-01, -7.784894002430293e-03]
ACKLAM_D = [3.754408661907416e00, 2.445134137142996e00, 3.224671290700398e-01, 7.784695709041462e-03]


def weighted_mean(value: str, weight: str, default: float = 0.0, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0))), F.lit(default)), digits)


def leaders(rows: DataFrame, key: str, score: str, top: int = 10) -> DataFrame:
    """Count and mean score for each key, the ``top`` by (-count, key) with their rank."""
    by = rows.groupBy(key).agg(F.count("*").alias("mentions"), F.avg(score).alias("mean_score"))
    best = by.orderBy(F.desc("mentions"), key).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mentions"), key)))


def recency_bucket(age_hours: Column) -> Column:
    return F.when(age_hours.isNull(), "unknown").when(age_hours <= 24, "today_signal").when(age_hours <= 72, "recent_pulse").when(age_hours <= 168, "weekly_trend").when(age_hours <= 720, "background_context").otherwise("archive_context")


def recency_summary(rows: DataFrame, key: str, age: str, score: str, source: str) -> DataFrame:
    """Cumulative counts and means over 24 h, 3, 7 and 30 days, and distinct sources."""
    upto = lambda h: F.col(age) <= h
    spans = {"24h": 24, "3d": 72, "7d": 168, "30d": 720}
    counts = [F.count_if(upto(h)).alias(f"n_{k}") for k, h in spans.items()]
    means = [F.coalesce(F.avg(F.when(upto(h), F.col(score))), F.lit(0.0)).alias(f"mean_{k}") for k, h in spans.items()]
    return rows.groupBy(key).agg(*counts, *means, F.countDistinct(source).alias("n_sources"))


def label_counts(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Counts for every label of a small table, zeros included."""
    return labels.join(rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")), "label", "left").fillna(0, ["n"])


def shares(rows: DataFrame, key: str) -> DataFrame:
    """``key, n, share`` of all rows; one row per key reaches the unkeyed window."""
    by = rows.groupBy(key).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_share(rows: DataFrame, key: str, warn_above: float) -> DataFrame:
    """The most frequent key (ties: the first by name), its share, and whether that is too much."""
    by = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = by.agg(F.min_by(F.struct(key, "n"), F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"))).alias("t"), F.sum("n").alias("total"))
    share = F.try_divide(F.col("t.n"), F.col("total"))
    return out.select(F.col(f"t.{key}").alias(key), share.alias("share"), F.coalesce(share > warn_above, F.lit(False)).alias("concentrated"))


def entropy_balance(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Normalised Shannon entropy (x 100) of ``key`` in each group; 0 with one class."""
    by = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    out = by.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.count("*").alias("k"))
    return out.select(group, F.when(F.col("k") > 1, F.col("h") / F.ln("k") * 100).otherwise(0.0).alias("balance"))


def coverage(rows: DataFrame, key: str) -> DataFrame:
    """Per ticker: counts by basis and sign (+-0.05), weighted mean, titles of the extremes.

    ``rows``: key, ``seq, title, score, weight, basis, confidence``. Ties go to the first.
    """
    count = lambda c: F.count_if(c)
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), *(count(F.col("basis") == b).alias(f"n_{b}") for b in ("full_text", "snippet", "title")),
        count(F.col("score") > 0.05).alias("n_positive"), count(F.col("score") < -0.05).alias("n_negative"), count(F.abs("score") <= 0.05).alias("n_neutral"),
        weighted_mean("score", "weight").alias("weighted_sentiment"), F.max_by("title", F.struct("score", -F.col("seq"))).alias("most_positive"), F.min_by("title", F.struct("score", F.col("seq"))).alias("most_negative"),
    )


def disagreement(rows: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """How often two scores have opposite signs (+-0.05), with a grade."""
    sign = lambda c: F.when(F.col(c) > 0.05, 1).when(F.col(c) < -0.05, -1).otherwise(0)
    rows = rows.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(sign(ours) * sign(theirs) < 0).alias("n_disagree"))
    ratio = F.col("n_disagree") / F.col("n")
    return out.withColumn("ratio", ratio).withColumn("grade", F.when(ratio <= 0.1, "aligned").when(ratio <= 0.3, "mixed").otherwise("divergent"))


def deciles(rows: DataFrame, value: str, out: str, n: int = 10) -> DataFrame:
    """Quantile cut into ``n`` bins of equal count, repeated edges dropped; bins are numbered from 0.

    The edges are one row, broadcast.
    """
    edges = rows.agg(F.array_distinct(F.percentile(value, F.array(*(F.lit(i / n) for i in range(n + 1))))).alias("_edges"))
    joined = rows.join(F.broadcast(edges))
    inside = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return joined.withColumn(out, F.greatest(inside - 1, F.lit(0))).drop("_edges")


def forecast_errors(rows: DataFrame, keys: Sequence[str], forecast: str, truth: str) -> DataFrame:
    e = F.col(forecast) - F.col(truth)
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def audit_summary(rows: DataFrame, feature: str, status: str, duration: str) -> DataFrame:
    """Counts and mean duration by feature, by status and in all, in one pass."""
    grouped = rows.groupingSets([[F.col(feature)], [F.col(status)], []], F.col(feature), F.col(status))
    return grouped.agg(F.count("*").alias("n"), F.avg(duration).alias("mean_duration"), F.grouping_id().alias("level"))


def success_rates(rows: DataFrame, key: str, ok: str, reason: str, seq: str) -> DataFrame:
    """Attempts, successes, rate, the last failure's reason and the most frequent one."""
    failed = ~F.col(ok)
    by_reason = rows.where(failed).groupBy(key, reason).agg(F.count("*").alias("n"))
    top = by_reason.groupBy(key).agg(F.min_by(reason, F.struct((-F.col("n")).alias("o"), F.col(reason).alias("r"))).alias("top_reason"))
    out = rows.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(F.col(ok)).alias("successes"), F.max_by(F.when(failed, F.col(reason)), F.when(failed, F.col(seq))).alias("last_reason"))
    return out.join(top, key, "left").withColumn("rate", F.col("successes") / F.col("attempts"))


def experiment_metrics(events: DataFrame, variation: str, user: str, event: str, value: str, conversion: str) -> DataFrame:
    """Users, conversions, rate, value and bounce (users with exactly one event) per variation.

    Users first, then variations: two partial aggregations instead of distinct counts.
    """
    hit = F.col(event) == conversion
    users = events.groupBy(variation, user).agg(F.count("*").alias("_n"), F.max(hit).alias("_hit"), F.sum(F.when(hit, F.col(value))).alias("_value"))
    return users.groupBy(variation).agg(
        F.count("*").alias("users"), F.count_if(F.col("_hit")).alias("conversions"), F.avg(F.col("_hit").cast("int")).alias("rate"), F.coalesce(F.sum("_value"), F.lit(0.0)).alias("value"), F.avg((F.col("_n") == 1).cast("int")).alias("bounce"))


def breakdown(events: DataFrame, variation: str, event: str) -> DataFrame:
    """A map of counts by event for each variation."""
    by = events.groupBy(variation, event).agg(F.count("*").alias("n"))
    return by.groupBy(variation).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(event, "n")))).alias("events"))


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """From the constant on, by Horner's rule."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """The normal distribution, by the error function's series of Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = polynomial(t, ERF_SERIES) * t * F.exp(-z * z) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution (Acklam), good to 1.2e-9 of the value; null beyond 0 to 1."""
    q = p - 0.5
    centre = polynomial(q * q, ACKLAM_A) * q / (polynomial(q * q, ACKLAM_B) * q * q + 1)
    r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(r, ACKLAM_C) / (polynomial(r, ACKLAM_D) * r + 1)
    return F.when((p > 0) & (p < 1), F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(centre))


def z_test(metrics: DataFrame, variation: str, control: str) -> DataFrame:
    """Two-proportion z-test of each variation against the control, one row each."""
    base = metrics.where(F.col(variation) == control).select(F.col("users").alias("_n0"), F.col("rate").alias("_p0"))
    rows = metrics.where(F.col(variation) != control).join(F.broadcast(base))
    n1, p1, n0, p0 = F.col("users"), F.col("rate"), F.col("_n0"), F.col("_p0")
    pooled = (n1 * p1 + n0 * p0) / (n1 + n0)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    out = rows.withColumns({"z": F.try_divide(p1 - p0, se), "lift": F.try_divide(p1 - p0, p0), "cohens_h": 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p0)), "_u": F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)})
    p_value = 2 * (1 - normal_cdf(F.abs("z")))
    return out.select(variation, "z", "lift", "cohens_h", (p1 - p0 - 1.959964 * F.col("_u")).alias("ci_low"), (p1 - p0 + 1.959964 * F.col("_u")).alias("ci_high"), p_value.alias("p_value"))


def experiment_plan(metrics: DataFrame, variation: str, control: str, confidence: float = 0.95, power: float = 0.8) -> DataFrame:
    """What a test could find, a row for each variation: significance, least detectable effect, power, sample size for that effect, winner and advice.

    The effect is Cohen's h of the control against the variation; the least
    effect supposes a base rate of a tenth, and the size is ``MIN_SAMPLE`` at
    least. Without users on a side, or without any spread, nothing is
    significant and the power is zero.
    """
    tested = z_test(metrics, variation, control).select(variation, "z", "p_value", "lift", (-F.col("cohens_h")).alias("effect_size"))
    base = metrics.where(F.col(variation) == control).select(F.col("users").alias("_n0"), F.col("rate").alias("_p0"))
    rows = metrics.select(variation, F.col("users").alias("_n1"), F.col("rate").alias("_p1")).join(tested, variation).join(F.broadcast(base))
    n1, n0, h = F.col("_n1"), F.col("_n0"), F.col("effect_size")
    alpha, beta = normal_quantile(F.lit(1 - (1 - confidence) / 2)), normal_quantile(F.lit(power))
    mean_n = F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))
    rows = rows.withColumn("mde", F.coalesce((alpha + beta) * F.sqrt(F.lit(2 * 0.1 * 0.9) / mean_n), F.lit(0.0)))
    reached = F.when((n1 > 0) & (n0 > 0) & (h != 0), normal_cdf(h * F.sqrt(mean_n / 2) - alpha)).otherwise(0.0)
    p2 = F.col("_p0") + F.col("mde")
    middle = (F.col("_p0") + p2) / 2
    size = F.when((F.col("_p0") == 0) | (F.col("mde") == 0), MIN_SAMPLE).otherwise(F.greatest(F.lit(MIN_SAMPLE), F.floor(2 * (alpha + beta) ** 2 * middle * (1 - middle) / (p2 - F.col("_p0")) ** 2)))
    p = F.col("p_value")
    label = F.when(F.col("z").isNull(), "not_significant").when(p < 0.01, "highly_significant").when(p < 0.05, "significant").when(p < 0.1, "marginally_significant").otherwise("not_significant")
    rows = rows.withColumns({"power": F.when(F.col("z").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reached))), "sample_size": size.cast("long"), "significance": label})
    winner = F.when(F.col("significance").isin("significant", "highly_significant"), F.when(F.col("_p1") > F.col("_p0"), F.col(variation)).otherwise(F.lit(control)))
    least_n = F.least(n1, n0)
    advice = F.filter(F.array(
        F.when(least_n < MIN_SAMPLE, "more_users"), F.when((F.col("significance") == "not_significant") & (F.col("power") < 0.8), "low_power"), F.when(F.abs(h) < 0.2, "small_effect").when(F.abs(h) > 0.8, "large_effect"),
        F.when(F.col("lift") * 100 > 10, "strong_lift").when(F.col("lift") * 100 < -5, "negative_lift")), lambda x: x.isNotNull())
    known = F.col("z").isNotNull()
    given = [F.when(known, F.col(c)).otherwise(x).alias(c) for c, x in (("p_value", 1.0), ("effect_size", 0.0), ("mde", NO_TEST_MDE), ("power", 0.0), ("sample_size", MIN_SAMPLE))]
    return rows.select(variation, "significance", *given, winner.alias("winner"), advice.alias("advice"))


def threshold_sweep(pairs: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``score >= threshold`` for each threshold."""
    rows = pairs.select(F.col(score).alias("_s"), F.col(label).alias("_y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("_s") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(hit & F.col("_y")).alias("tp"), F.count_if(hit & ~F.col("_y")).alias("fp"), F.count_if(~hit & F.col("_y")).alias("fn"), F.count_if(~hit & ~F.col("_y")).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({"precision": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the best (f1, precision, threshold)."""
    return sweep.agg(F.max(F.struct("f1", "precision", "threshold")).alias("b")).select("b.threshold", "b.f1", "b.precision")


def discrete_quantile(value: str, q: float) -> Column:
    """The element at place int(q n) of the sorted values, of which a group must not have too many for one row."""
    values = F.array_sort(F.collect_list(value))
    return F.element_at(values, F.least(F.floor(F.lit(q) * F.size(values)) + 1, F.size(values)).cast("int"))


def pipeline_metrics(rows: DataFrame, key: str, status: str, seconds: str) -> DataFrame:
    """Rates of success, error and duplicate, throughput, mean and discrete p95 of the time taken.

    Ranks are taken by a window, so no group becomes one array.
    """
    n = F.count("*").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(seconds))
    ranked = rows.withColumns({"_p": place, "_at": F.least(F.floor(n * 0.95) + 1, n)})
    share = lambda s: F.count_if(F.col(status) == s) / F.greatest(F.count("*"), F.lit(1))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), *(share(s).alias(f"{s}_rate") for s in ("success", "error", "duplicate")), F.avg(seconds).alias("mean_seconds"), F.max(F.when(F.col("_p") == F.col("_at"), F.col(seconds))).alias("p95"))
