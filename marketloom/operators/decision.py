"""Scores, rules and alerts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.operators import timeseries as ts

# Weights of recency buckets, bases, tiers and matches.
TIER_FACTOR = {1: 1.3, 2: 1.0, 3: 0.55, 4: 0.0}
BASIS_FACTOR = {"full_text": 1.25, "snippet": 0.75, "title": 0.4}
MATCH_FACTOR = {"high": 1.0, "medium": 0.65, "low": 0.2}
TIER_POINTS = {1: 30, 2: 22, 3: 8, 4: -100}
RECENCY_POINTS = {"today_signal": 20, "recent_pulse": 15, "weekly_trend": 9, "background_context": 3}
BASIS_POINTS = {"full_text": 18, "snippet": 10, "title": 4}


def lookup(column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(column) if isinstance(column, str) else column), F.lit(default))


def ladder(value: Column, *steps: tuple[float, str], other: str) -> Column:
    """The name of the first threshold that ``value`` reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(value >= limit, name)
    return out.otherwise(other)


def sentiment_weight(factors: dict[str, Column]) -> tuple[Column, Column]:
    """(weight, reasons): the product of all factors, and each of them as text."""
    weight = F.lit(1.0)
    for f in factors.values():
        weight = weight * f
    return F.round(weight, 6), F.array(*(F.concat(F.lit(f"{k}="), F.format_number(v, 2)) for k, v in factors.items()))


def ranking_score(tier, bucket, basis, n_tickers, direct, publishers, sources, seriousness, sentiment, acquisition) -> Column:
    """The additive score of an article; the recency bucket is the real one."""
    points = lookup(tier, TIER_POINTS, 12) + lookup(bucket, RECENCY_POINTS, 0) + lookup(basis, BASIS_POINTS, 4)
    points = points + F.when(n_tickers == 1, 12).when(n_tickers > 1, 7).otherwise(0) + F.when(direct, 10).otherwise(0)
    points = points + F.least(F.lit(8), F.greatest(F.lit(0), publishers - 1) * 3 + F.greatest(F.lit(0), sources - 1) * 2) + F.coalesce(seriousness, F.lit(0))
    return F.round(points + F.least(F.lit(8.0), F.abs(sentiment) * 8) + F.least(F.lit(12.0), F.greatest(F.lit(0.0), acquisition) * 0.12), 2)


def ticker_confidence(in_title, n_title, first, in_snippet, in_body, other_company, roundup) -> Column:
    """The confidence ladder of a ticker's match with an article."""
    primary = in_title & first & (n_title == 1)
    return (
        F.when(primary, 0.95).when(in_title & (n_title > 1), F.when(roundup, 0.45).otherwise(0.6)).when(in_title, 0.85)
        .when(in_snippet & other_company, 0.2).when(in_snippet, 0.6).when(in_body & other_company, 0.15).when(in_body, 0.5)
    )


def content_reasons(checks: dict[str, Column]) -> Column:
    """All failed checks by name; an empty array passes."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def first_reason(checks: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks), F.lit(default))


def source_visibility(articles: DataFrame, tier_limit: int = 3, better: int = 3) -> DataFrame:
    """``visible`` and ``reason``: low tiers give way where a ticker has enough better sources.

    ``articles``: ``id, tier, tickers``. Better sources are counted per ticker
    and joined back to the articles of tier 3 only.
    """
    per_ticker = articles.select("tier", F.explode("tickers").alias("t")).where(F.col("tier") <= F.least(F.lit(tier_limit), F.lit(2))).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= better).select("t")
    crowded = articles.where("tier = 3").select("id", F.explode("tickers").alias("t")).join(per_ticker, "t").select("id").distinct().withColumn("_crowded", F.lit(True))
    rows = articles.join(crowded, "id", "left")
    reason = first_reason([("below_min_source_quality_tier", F.col("tier") > tier_limit), ("tier_4_excluded_by_default", F.col("tier") == 4), ("tier_3_without_ticker", (F.col("tier") == 3) & (F.size("tickers") == 0)), ("tier_3_deprioritized_by_better_sources", (F.col("tier") == 3) & F.coalesce("_crowded", F.lit(False)))], "visible")
    return rows.withColumn("reason", reason).drop("_crowded").withColumn("visible", F.col("reason") == "visible")


def price_alerts(prices: DataFrame, threshold: float = 5.0, days: int = 1) -> DataFrame:
    """Moves of the last close against ``days`` rows before, with severity, per symbol."""
    card = ts.period_returns(prices, {"move": days + 1}).withColumn("percent", F.col("move") * 100)
    size = F.abs("percent")
    hits = card.where(size >= threshold)
    return hits.select("symbol", "percent", F.when(F.col("percent") > 0, "up").otherwise("down").alias("direction"), ladder(size, (15.0, "CRITICAL"), (10.0, "HIGH"), (5.0, "MEDIUM"), other="LOW").alias("severity"))


def sentiment_swings(daily: DataFrame, threshold: float = 0.3, days: int = 7) -> DataFrame:
    """The last daily value against the mean of up to ``days`` before it, for symbols with as many."""
    ranked = daily.withColumn("_r", F.row_number().over(ts.by_symbol(descending=True)))
    out = ranked.groupBy("symbol").agg(F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("now"), F.avg(F.when((F.col("_r") > 1) & (F.col("_r") <= days + 1), F.col("value"))).alias("before"), F.count("*").alias("_n"))
    out = out.where((F.col("_n") >= days) & F.col("before").isNotNull()).withColumn("change", F.col("now") - F.col("before"))
    return out.where(F.abs("change") >= threshold).select("symbol", "now", "before", "change", ladder(F.abs("change"), (0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), other="LOW").alias("severity"))


def earnings_proximity(calendar: DataFrame, as_of: str, days: Sequence[int] = (7, 3, 1)) -> DataFrame:
    """Symbols whose event lies exactly so many days ahead of ``as_of``."""
    left = F.datediff("event_date", F.lit(as_of).cast("date"))
    return calendar.withColumn("days_until", left).where(F.col("days_until").isin(list(days)))


def with_cooldown(alerts: DataFrame, minutes: int = 60) -> DataFrame:
    """Alerts of a symbol that come at least so long after the last one kept, in order of time."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, keep = pdf.sort_values(["ts", "id"]), None, []
        for t in pdf["ts"]:
            ok = last is None or t - last >= pd.Timedelta(minutes=minutes)
            last = t if ok else last
            keep.append(ok)
        return pdf[keep]

    return alerts.groupBy("symbol").applyInPandas(one, alerts.schema)


def rule_engine(rows: DataFrame, rules: Sequence[tuple[str, Column, str, float]], default: str = "hold") -> DataFrame:
    """``rule, action, confidence`` of the first rule whose condition holds: one ``when`` chain."""
    hit = F.coalesce(*(F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"), F.lit(conf).alias("confidence"))) for name, c, action, conf in rules), F.struct(F.lit("default").alias("rule"), F.lit(default).alias("action"), F.lit(0.5).alias("confidence")))
    return rows.withColumn("_hit", hit).select("*", "_hit.*").drop("_hit")


def staleness(age_minutes: Column, at: Column, market: float, after: float, weekend: float, grace: float = 1.0) -> Column:
    """``fresh``, ``stale`` or ``critical`` by the limit that holds at the time (UTC, market 14:30 to 21:00)."""
    minute = F.hour(at) * 60 + F.minute(at)
    limit = F.when(F.weekday(at) >= 5, weekend).when((minute >= 870) & (minute < 1260), market).otherwise(after) * grace
    return F.when(age_minutes <= limit, "fresh").when(age_minutes <= 2 * limit, "stale").otherwise("critical")


def ohlcv_quality(prices: DataFrame, as_of: str) -> DataFrame:
    """Six dimensions and the weighted quality of each symbol's history, 0 to 1, with a rating."""
    checked = ts.plausibility(prices).join(prices, ["symbol", "date"])
    fine = lambda c: F.avg((~F.coalesce(c, F.lit(True))).cast("int"))
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in ("open", "high", "low", "close", "volume")))
    days = F.datediff(F.lit(as_of).cast("date"), F.max("date"))
    out = checked.groupBy("symbol").agg(
        (1 - F.avg(missing)).alias("completeness"), fine(F.col("bad_range") | F.col("big_change")).alias("accuracy"), fine(F.col("big_gap")).alias("consistency"),
        F.greatest(F.lit(0.0), 1 - days / 30).alias("timeliness"), fine((F.col("close") <= 0) | (F.col("volume") < 0)).alias("validity"), F.try_divide(F.countDistinct("date"), F.count("*")).alias("uniqueness"),
    )
    weights = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "validity": 0.10, "uniqueness": 0.05}
    score = F.lit(0.0)
    for name, w in weights.items():
        score = score + F.col(name) * w
    return out.withColumn("quality", score).withColumn("rating", ladder(F.col("quality"), (0.95, "excellent"), (0.85, "good"), (0.7, "fair"), other="poor"))


def storage_tier(age_days: Column) -> Column:
    return F.when(age_days <= 180, "hot").when(age_days <= 730, "warm").when(age_days <= 2555, "cold").otherwise("archive")


def direction_forecast(mean_sentiment: Column, limit: float = 0.1) -> Column:
    return F.when(mean_sentiment > limit, "up").when(mean_sentiment < -limit, "down").otherwise("flat")


def kelly_size(win_rate: Column, payoff: Column, cap: float = 0.25) -> Column:
    """Kelly fraction between 0 and ``cap``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(win_rate - F.try_divide(1 - win_rate, payoff), F.lit(0.0))))


def flag_enabled(user, percent: int, salt: str = "") -> Column:
    """A gradual roll-out: the user's bucket of 100 lies below ``percent``."""
    from marketloom.functions.text import md5_bucket

    return md5_bucket(F.concat(F.lit(salt), user.cast("string"))) < percent


def segment_enabled(segments: list[str], *columns) -> Column:
    """On for a user any of whose columns names a target segment; null names none."""
    return F.coalesce(*(F.when(F.col(c).isin(segments), True) for c in columns), F.lit(False))


def canary_enabled(user, tester: Column, value: Column, percent: int, salt: str = "", least: float = 100_000) -> Column:
    """A gradual roll-out among testers and users worth more than ``least`` alone."""
    return (F.coalesce(tester, F.lit(False)) | F.coalesce(value > least, F.lit(False))) & flag_enabled(user, percent, salt)


def weighted_variation(bucket: Column, weights: dict[str, int]) -> Column:
    """The variation whose cumulative weight the bucket falls below."""
    out, upto = None, 0
    for name, w in weights.items():
        upto += w
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out.otherwise(list(weights)[-1])


def alert_lifecycle(states: DataFrame) -> DataFrame:
    """Episodes of bad states per source: ``source, opened, last_seen, n``; equal neighbours are one episode."""
    order = Window.partitionBy("source").orderBy("ts", "id")
    started = (F.col("bad") & ~F.coalesce(F.lag("bad").over(order), F.lit(False))).cast("int")
    rows = states.withColumn("_s", started).withColumn("_episode", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("bad")
    return rows.groupBy("source", "_episode").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).drop("_episode")
