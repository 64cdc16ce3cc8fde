"""Scores of articles, events and symbols, and the decisions made on them."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.functions.text import let
from marketloom.operators import timeseries as ts
from marketloom.operators.decision import content_reasons, first_reason, ladder, lookup

# Points and weights of the scores below.
PUBLISHER_QUALITY = {1: 100.0, 2: 75.0, 3: 40.0, 4: 0.0}
EVENT_TIER_POINTS = {1: 18.0, 2: 10.0, 3: 1.0, 4: -20.0}
QUEUE_RECENCY = {"today_signal": 20, "recent_pulse": 14, "weekly_trend": 8, "background_context": 2}
QUEUE_TIER = {1: 30, 2: 22, 3: 8, 4: -100}
SYMBOL_FORMAT = r"^[A-Z]{1,5}([.-][A-Z]{1,2})?$"
ACTIONS = ["buy", "hold", "reduce", "exit"]
SEC_WORDS = ["8-k", "10-k", "10-q", "sec filing", "securities filing", "regulatory filing", "edgar", "sec.gov"]


def clipped(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def acquisition_scores(articles: DataFrame) -> DataFrame:
    """``acquisition`` of each article: priority, publisher, ticker, diversity, novelty, extraction, seriousness.

    ``articles``: ``id, url, publisher, priority, tier, ticker_confidence, direct, seriousness``. The first
    row of a URL is new. Publisher counts and first ids are partial sums joined back.
    """
    per = articles.groupBy("publisher").agg(F.count("*").alias("_n"))
    new = articles.groupBy("url").agg(F.min("id").alias("_first"))
    rows = articles.join(per, "publisher").join(new, "url")
    score = (
        F.coalesce("priority", F.lit(50.0)) * 0.22 + lookup("tier", PUBLISHER_QUALITY, 60.0) * 0.18 + F.coalesce("ticker_confidence", F.lit(0.0)) * 100 * 0.2 + 100.0 / F.col("_n") * 0.08
        + F.when(F.col("id") == F.col("_first"), 100.0).otherwise(0.0) * 0.08 + F.when(F.col("direct"), 95.0).otherwise(20.0) * 0.14 + clipped(50.0 + F.coalesce("seriousness", F.lit(0)) * 3.0, 0.0, 100.0) * 0.1
    )
    return rows.withColumn("acquisition", F.round(score, 3)).drop("_n", "_first")


def event_priority(group, status, tier, sources, change, official, disagreement, seriousness, backstop, n_uncertain) -> tuple[Column, Column]:
    """(score, reasons) of an event for the briefing."""
    moved = F.least(F.lit(15.0), F.abs(F.coalesce(change, F.lit(0.0))) * 50)
    score = (
        F.when(group == "portfolio", 22.0).when(group == "watchlist", 10.0).otherwise(0.0) + F.when(status == "fuzzy_event_repeat", 14.0).when(status == "exact_url_repeat", 10.0).when(status == "likely_new_event", 8.0).otherwise(0.0)
        + lookup(tier, EVENT_TIER_POINTS, -3.0) + F.least(F.lit(15.0), (F.greatest(F.lit(1), sources) - 1) * 5.0) + moved + F.when(official, 20.0).otherwise(0.0) + F.when(disagreement, 8.0).otherwise(0.0)
        + seriousness - F.when(backstop, 5.0).otherwise(0.0) - F.least(F.lit(18.0), n_uncertain * 3.0)
    )
    reasons = content_reasons({
        "portfolio_holding": group == "portfolio", "watchlist_name": group == "watchlist", "developing_fuzzy_repeat": status == "fuzzy_event_repeat", "developing_exact_repeat": status == "exact_url_repeat",
        "likely_new_event": status == "likely_new_event", "multi_source_support": sources > 1, "meaningful_sentiment_change": moved >= 2.5, "official_or_sec_signal": official, "benchmark_disagreement": disagreement,
        "high_importance_article_type": seriousness >= 10, "low_importance_article_type": seriousness < 0, "google_backstop_penalty": backstop, "uncertainty_penalty": n_uncertain > 0,
    })
    return F.round(F.greatest(F.lit(0.0), score), 2), reasons


def technical_score(rsi, macd, position, sma_20, sma_50, volume_ratio, momentum) -> Column:
    """-5 to 5 from the last indicators."""
    return clipped(
        F.when(rsi < 30, 1.5).when(rsi > 70, -1.5).otherwise((50 - rsi) / 50) + clipped(macd * 2, -2.0, 2.0) + (position - 0.5) * 2 + F.when(sma_20 > sma_50, 0.5).otherwise(-0.5)
        + F.when(volume_ratio > 1.5, 0.5).when(volume_ratio < 0.5, -0.5).otherwise(0.0) + clipped(momentum * 5, -1.0, 1.0), -5.0, 5.0)


def fundamental_score(pe, pb, debt, roe, revenue_growth, earnings_growth) -> Column:
    """-5 to 5 from the bands of six ratios."""
    band = lambda good, bad, points: F.when(good, points).when(bad, -points).otherwise(0.0)
    parts = [band((pe >= 10) & (pe <= 18), pe > 25, 1.0), band(pb < 2, pb > 4, 0.5), band(debt < 0.3, debt > 0.8, 0.5), band(roe > 0.15, roe < 0.08, 1.0), band(revenue_growth > 0.1, revenue_growth < 0, 1.0), band(earnings_growth > 0.15, earnings_growth < 0, 1.0)]
    return clipped(sum(parts[1:], parts[0]), -5.0, 5.0)


def sentiment_score(ewma, confident_ratio, trend, conviction) -> Column:
    return clipped(ewma * 3 + confident_ratio + trend * 0.5 + conviction / 10.0, -5.0, 5.0)


def fusion_score(sentiment, technical, fundamental, volatility, sharpe, weights: dict[str, float]) -> Column:
    """The weighted score less a penalty for volatile or poorly paid symbols; whole numbers are weighted exactly, so a score at a limit of ``action`` is not moved below it."""
    exact = {k: F.lit(Decimal(str(w))) for k, w in weights.items()}
    penalty = F.when(volatility > 0.4, Decimal("-1.0")).when(sharpe < 0.5, Decimal("-0.5")).otherwise(Decimal("0.0"))
    return clipped(sentiment * exact["sentiment"] + technical * exact["technical"] + fundamental * exact["fundamental"] + penalty * exact["risk"], -5.0, 5.0)


def action(score, buy: Column, sell: Column, tolerance: str = "moderate") -> Column:
    """The action by a regime's thresholds, wider apart for the conservative."""
    shift = {"conservative": 0.1, "aggressive": -0.1}.get(tolerance, 0.0)
    b, s = buy + shift, sell - shift
    return F.when(score >= b + 1.0, "strong_buy").when(score >= b, "buy").when(score <= s - 1.0, "strong_sell").when(score <= s, "sell").otherwise("hold")


def conviction_action(score, conviction, least: float) -> Column:
    return F.when(conviction < least, "hold").otherwise(ladder(score, (3.0, "strong_buy"), (1.5, "buy"), (-1.4999999, "hold"), (-2.9999999, "sell"), other="strong_sell"))


def triple_barrier(prices: DataFrame, sentiment: DataFrame, k: float = 2.0) -> DataFrame:
    """Barriers around the last close by the EWM deviation of returns, and the signal of the last ten sentiments."""
    import math

    rets = prices.select("symbol", "date", "close", ts.simple_return().alias("ret"))
    dev = ts.ewm_std(rets, "ret", 20, "dev")
    last = dev.groupBy("symbol").agg(F.max_by("close", "date").alias("close"), (F.max_by("dev", "date") * math.sqrt(252)).alias("volatility"))
    ranked = sentiment.withColumn("_r", F.row_number().over(ts.by_symbol(descending=True)))
    mood = ranked.where("_r <= 10").groupBy("symbol").agg(F.when(F.count("*") >= 10, F.avg("value")).otherwise(0.0).alias("mood"))
    out = last.join(mood, "symbol", "left")
    return out.select("symbol", (F.col("close") * (1 + k * F.col("volatility"))).alias("upper"), (F.col("close") * (1 - k * F.col("volatility"))).alias("lower"), F.when(F.col("mood") > 0.3, 1).when(F.col("mood") < -0.3, -1).otherwise(0).alias("signal"))


def implied_move(prices: DataFrame, cap: float = 25.0) -> DataFrame:
    """The weekly move (percent) that annual volatility implies, and the 95th percentile of absolute daily moves."""
    import math

    rets = prices.select("symbol", ts.simple_return().alias("ret"))
    week = math.sqrt(252) * math.sqrt(7 / 365.25) * 100
    return rets.groupBy("symbol").agg(F.round(F.least(F.stddev_samp("ret") * week, F.lit(cap)), 1).alias("implied_move"), F.round(F.percentile(F.abs("ret"), F.lit(0.95)) * 100, 1).alias("typical_move"), F.count("ret").alias("n")).where("n >= 5").drop("n")


def corroboration(headlines: DataFrame, primary_domains: Sequence[str], official: str, rumours: Sequence[str]) -> DataFrame:
    """``flags, boost, corroborated, confidence`` of each headline (``url, title``)."""
    url, title = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    rows = headlines.withColumns({"_p": any_of(host, primary_domains), "_o": url.rlike(official), "_s": url.contains("sec.gov") | url.contains("edgar") | any_of(title, SEC_WORDS)})
    known = F.col("_p") | F.col("_o") | F.col("_s")
    rumour = any_of(title, rumours) & ~known
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    boost = points(F.col("_p"), 0.3) + points(F.col("_o"), 0.2) + points(F.col("_s"), 0.25) + points(rumour, -0.2)
    out = rows.withColumns({"flags": content_reasons({"primary_source": F.col("_p"), "official_company": F.col("_o"), "sec_filing": F.col("_s"), "speculative": rumour}), "boost": boost, "corroborated": known})
    return out.withColumn("confidence", clipped(0.5 + F.col("boost"), 0.0, 1.0)).drop("_p", "_o", "_s")


def corroboration_stats(rows: DataFrame, *keys: str) -> DataFrame:
    share = lambda c: F.round(F.count_if(c) / F.count("*") * 100, 1)
    flag = lambda f: F.array_contains("flags", f)
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("corroborated").alias("corroborated"), share(F.col("corroborated")).alias("corroborated_pct"), F.count_if(flag("speculative")).alias("speculative"), share(flag("speculative")).alias("speculative_pct"), F.count_if(flag("primary_source")).alias("primary_sources"), F.avg("confidence").alias("confidence"))


def publication(duplicate, quality, relevance, good: float = 0.6, relevant: float = 0.5) -> Column:
    return F.when(duplicate | (quality < 0.4) | (relevance < 0.3), "reject").when((quality >= good) & (relevance >= relevant), "publish").otherwise("review")


def symbol_intake(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """``seq, symbol, reason``: null reasons are accepted; the first of a batch wins.

    ``candidates``: ``seq, symbol``; ``registry``: ``symbol``.
    """
    rows = candidates.select("seq", F.upper(F.trim("symbol")).alias("symbol"))
    known = registry.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("seq"))
    judged = rows.join(known, "symbol", "left").withColumn("_nth", nth)
    reason = first_reason([("invalid_type", F.coalesce(F.col("symbol"), F.lit("")) == ""), ("invalid_format", ~F.col("symbol").rlike(SYMBOL_FORMAT)), ("duplicate", F.col("_known").isNotNull() | (F.col("_nth") > 1))])
    return judged.select("seq", "symbol", reason.alias("reason"))


def recommendation_summary(rows: DataFrame) -> DataFrame:
    """Counts of the four actions, mean confidence, how many are sure, and the three surest."""
    top = rows.orderBy(F.desc("confidence"), "symbol").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "symbol"))).alias("t")).select(F.transform("t", lambda x: x["symbol"]).alias("top"))
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("average_confidence"), F.count_if(F.col("confidence") >= 0.8).alias("high_conviction"))
    return counts.join(F.broadcast(top))


def queue_scores(rows: DataFrame) -> DataFrame:
    """``score`` and ``skip_reason`` of articles that might be fetched."""
    score = (
        F.col("confidence") * 40 + lookup("tier", QUEUE_TIER, 12) + lookup("bucket", QUEUE_RECENCY, 0) + F.coalesce("seriousness", F.lit(0)) + F.when(F.col("direct"), 30).otherwise(-20)
        + F.when(F.col("primary"), 10).otherwise(0) + F.when(F.col("portfolio"), 6).otherwise(3) + F.least(F.lit(8), F.col("diversity")) + F.col("acquisition") * 0.15
    )
    skip = first_reason([("fetch_disabled_by_source_profile", ~F.col("fetch_allowed")), ("no_ticker_specific_match", F.col("confidence") <= 0), ("low_source_quality", F.col("tier") >= 3)])
    return rows.withColumns({"score": F.round(score, 4), "skip_reason": skip})


def extraction_queue(rows: DataFrame, per_ticker: int = 5, total: int = 75) -> DataFrame:
    """The best article of each cluster, at most so many for a ticker and in all, in order of score.

    A cluster's other articles never count against a ticker, so the best of each
    comes first; the two caps follow in the global order.
    """
    best = rows.where("skip_reason is null").withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "id"))).where("_r = 1")
    capped = best.withColumn("_t", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("score"), "id"))).where(F.col("_t") <= per_ticker)
    return capped.orderBy(F.desc("score"), "id").limit(total).drop("_r", "_t")


def text_quality(text, sentences) -> Column:
    """Points of an extracted article by its length and number of sentences, 0 to 100."""
    by_length = F.when(F.length(text) >= 1600, 30).when(F.length(text) >= 800, 24).when(F.length(text) >= 400, 16).when(F.length(text) >= 220, 8).otherwise(-12)
    by_sentences = F.when(sentences >= 10, 20).when(sentences >= 5, 14).when(sentences >= 3, 8).otherwise(-8)
    return clipped(F.lit(10.0) + by_length + by_sentences, 0.0, 100.0)


def query_budget(plans: DataFrame, budget: int) -> DataFrame:
    """The best plan of each ticker, then the best ``budget`` tickers (score, fewer benchmarks, name)."""
    best = plans.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("score"), "plan"))).where("_r = 1").drop("_r")
    return best.orderBy(F.desc("score"), "benchmarks", "ticker").limit(budget)


def query_plans(tickers: DataFrame, providers: DataFrame, templates: Sequence[str]) -> DataFrame:
    """Every query of every provider for every ticker; both tables are configuration, and broadcast."""
    texts = F.array(*(F.replace(F.replace(F.lit(t), F.lit("{symbol}"), F.col("symbol")), F.lit("{company}"), F.col("company")) for t in templates))
    return tickers.join(F.broadcast(providers)).select("symbol", "provider", F.posexplode(texts).alias("n", "query"))


def token_estimate(text, per_million: float, chars_per_token: float = 4.0) -> tuple[Column, Column]:
    """(tokens, cost) of a payload by its length."""
    tokens = F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token)
    return tokens, tokens * per_million / 1e6


def upcoming(calendar: DataFrame, as_of: str, days: int = 14, tie: str | None = None) -> DataFrame:
    """Events from ``as_of`` on for so many days, the next of each symbol marked; of one day the least ``tie``."""
    left = F.datediff("event_date", F.lit(as_of).cast("date"))
    rows = calendar.withColumn("days_until", left).where((F.col("days_until") >= 0) & (F.col("days_until") <= days))
    return rows.withColumn("next", F.row_number().over(Window.partitionBy("symbol").orderBy("event_date", *([tie] if tie else []))) == 1)


def position_context(positions: DataFrame, capital: float = 100_000.0, cap: float = 0.5) -> DataFrame:
    """Profit and share of the capital of ``symbol, shares, cost, price``."""
    value = F.col("shares") * F.col("price")
    return positions.withColumns({"value": value, "profit": value - F.col("shares") * F.col("cost"), "profit_pct": ts.ratio_change(F.col("price"), F.col("cost")), "share": F.least(F.lit(cap), value / capital)})


def parameter_sweep(df: DataFrame, decays: Sequence[float] = (0.2, 0.94), windows: Sequence[int] = (29, 90)) -> DataFrame:
    """``symbol, decay, window, decayed`` for all settings, from one ranking of each series."""
    ranked = df.withColumn("_i", F.row_number().over(ts.by_symbol(descending=True)) - 1)
    grid = F.explode(F.array(*(F.struct(F.lit(d).alias("decay"), F.lit(n).alias("window")) for d in decays for n in windows)))
    rows = ranked.select("symbol", "value", "_i", grid.alias("p")).select("symbol", "value", "_i", "p.*").where(F.col("_i") < F.col("window"))
    w = (1 - F.col("decay")) * F.pow("decay", "_i")
    return rows.groupBy("symbol", "decay", "window").agg(F.try_divide(F.sum(w * F.col("value")), F.sum(w)).alias("decayed"))


def article_insights(rows: DataFrame) -> DataFrame:
    """Per ticker: mean, deviation and signs of ``(relevance - 0.5) * 2``, duplicates, actions, sources."""
    s = (F.col("relevance") - 0.5) * 2
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.count_if(s > 0.1).alias("positive"), F.count_if(s < -0.1).alias("negative"), F.count_if("duplicate").alias("duplicates"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("publish", "review", "reject")), F.countDistinct("source").alias("sources"))


def concentration_weights(articles: DataFrame, provider_limit: float = 0.5, ticker_limit: float = 0.3) -> DataFrame:
    """Down-weights of articles whose provider or ticker has more than its share."""
    def factor(key: str, limit: float) -> DataFrame:
        by = articles.groupBy(key).agg(F.count("*").alias("_n"))
        share = F.col("_n") / F.sum("_n").over(Window.partitionBy())
        return by.select(key, F.when(share > limit, F.round(limit / share, 4)).otherwise(1.0).alias(f"{key}_factor"))

    return articles.join(factor("provider", provider_limit), "provider").join(factor("ticker", ticker_limit), "ticker")


def operational_alerts(metrics: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """One row for each metric column above its limit."""
    hits = F.filter(F.array(*(F.when(F.col(c) > limit, F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(s).alias("severity"))) for c, (limit, s) in limits.items())), lambda x: x.isNotNull())
    return metrics.select("key", F.explode(hits).alias("a")).select("key", "a.*")


def source_permission(rows: DataFrame) -> DataFrame:
    """``allowed, reason`` of sources, first rule first."""
    reason = first_reason([("disabled", ~F.col("enabled")), ("terms_forbid", F.col("terms") == "forbidden"), ("login_required", F.col("login")), ("robots_unknown", F.col("robots").isNull())], "allowed")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed")


def keyword_relevance(text, categories: dict[str, tuple[list[str], float]]) -> Column:
    """0 to 1: per category its share of keywords found, times three, capped at 1, weighted."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0.0)
    for words, weight in categories.values():
        found = sum((lower.contains(w).cast("int") for w in words), F.lit(0))
        score = score + F.least(F.lit(1.0), found / len(words) * 3) * weight
    return F.when(F.trim(lower) == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def direction_vote(momentum, consensus, sector, options, volatile, data_quality) -> tuple[Column, Column]:
    """(prediction, confidence) of the move after an event from five signals."""
    side = lambda x, limit, points: (F.when(x > limit, points).otherwise(0), F.when(x < -limit, points).otherwise(0))
    pairs = [side(momentum, 0.05, 2), side(consensus, 0.15, 2), side(sector, 0.02, 1), (F.when(options == "bullish", 1).otherwise(0), F.when(options == "bearish", 1).otherwise(0))]
    up, down = sum((p[0] for p in pairs), F.lit(0)), sum((p[1] for p in pairs), F.lit(0))
    flat = lambda p: F.when(p[0] + p[1] == 0, 1).otherwise(0)
    unsure = flat(pairs[0]) + flat(pairs[1]) + flat(pairs[3]) + F.when(volatile, 2).otherwise(0)
    mixed = (unsure >= 3) | (F.abs(up - down) <= 1)
    prediction = F.when(mixed, "Big Swing Unsure").when(up > down, "Up").otherwise("Down")
    confidence = F.when(mixed, 0.4).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(up - down) * 0.1)) * F.when(data_quality < 0.5, 0.7).otherwise(1.0)
    return prediction, F.round(confidence, 2)


def term_relevance(text, title, name: str, symbol: str, keywords: Sequence[str], reach: int = 100) -> Column:
    """0 to 1 by mentions, the title, and keywords within ``reach`` characters of a mention."""
    head = F.lower(F.coalesce(title, F.lit("")))
    # a text is cut at its mentions, which gives their places; a window opens ``reach`` before a mention, but not in the window before, and ends ``reach`` after the last mention within ``reach`` of its start
    said = lambda w: sum((w.contains(k).cast("int") for k in keywords), F.lit(0))
    size, state = len(symbol), "struct<hits:int,place:int,start:int,last:int>"

    def hits_of(lower: Column, parts: Column) -> Column:
        # places count from 0; a start of -1 is no window yet
        begin = F.struct(F.lit(0).alias("hits"), F.length(parts[0]).alias("place"), F.lit(-1).alias("start"), F.lit(-1).alias("last")).cast(state)
        end = lambda x: x["last"] + size + reach
        window = lambda x: F.when(x["start"] < 0, 0).otherwise(said(F.substring(lower, x["start"] + 1, end(x) - x["start"])))

        def step(x: Column, part: Column) -> Column:
            at, fresh = x["place"], x["start"] < 0
            grows = ~fresh & (at - x["start"] <= reach)
            opens = fresh | (~grows & (at >= end(x)))
            return F.struct(
                (x["hits"] + F.when(opens, window(x)).otherwise(0)).alias("hits"), (at + size + F.length(part)).alias("place"),
                F.when(opens, F.greatest(F.when(fresh, 0).otherwise(end(x)), at - reach)).otherwise(x["start"]).alias("start"), F.when(opens | grows, at).otherwise(x["last"]).alias("last"),
            ).cast(state)

        return F.aggregate(F.slice(parts, 2, F.size(parts)), begin, step, lambda x: x["hits"] + window(x))

    # mentions and hits in one, as the text is cut once
    lower = F.lower(F.coalesce(text, F.lit("")))
    found = let(lower, lambda t: let(F.split(t, rf"\b{symbol.lower()}\b", -1), lambda p: F.struct((F.size(p) - 1).alias("mentions"), hits_of(t, p).alias("hits"))))
    boost = F.when(head.contains(symbol.lower()), 0.3).otherwise(0.0) + F.when(head.contains(name.lower()), 0.4).otherwise(0.0)
    score = lambda x: F.least(F.lit(1.0), F.least(F.lit(1.0), x["mentions"] * 0.3) + boost + F.least(F.lit(0.4), x["hits"] * 0.1))
    return let(found, score)


def experiment_advice(users, rate, base_rate, p_value, effect, least_users: int = 1000) -> Column:
    """Advice on a finished experiment, all that applies."""
    lift = F.try_divide(rate - base_rate, base_rate)
    return content_reasons({
        "increase_sample_size": users < least_users, "small_effect": F.abs(effect) < 0.2, "large_effect": F.abs(effect) > 0.8, "strong_positive_lift": lift > 0.1, "negative_impact": lift < -0.05,
        "highly_significant": p_value < 0.01, "significant": (p_value >= 0.01) & (p_value < 0.05), "not_significant": p_value >= 0.05,
    })


def overall_quality(parts: dict[str, tuple[Column, float]], weak: float = 0.4, strong: float = 0.8) -> dict[str, Column]:
    """``overall`` (weighted), ``issues`` and ``strengths`` (parts below and above a limit)."""
    total = F.lit(0.0)
    for value, weight in parts.values():
        total = total + value * weight
    return {"overall": total, "issues": content_reasons({n: v < weak for n, (v, _) in parts.items()}), "strengths": content_reasons({n: v > strong for n, (v, _) in parts.items()})}


def quality_summary(rows: DataFrame, top: int = 5) -> DataFrame:
    """Mean, population deviation, extremes and the most frequent issues of ``overall, issues``."""
    often = rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(top)
    listed = often.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "issue"))), lambda x: x["issue"]).alias("top_issues"))
    return rows.agg(F.count("*").alias("n"), F.avg("overall").alias("mean"), F.stddev_pop("overall").alias("std"), F.min("overall").alias("low"), F.max("overall").alias("high")).join(F.broadcast(listed))


def briefing_packets(events: DataFrame, change: DataFrame) -> DataFrame:
    """One packet per ticker and event: days active, sources, the change of sentiment, what is uncertain.

    ``events``: ``ticker, event, day, source, confidence``; ``change``: ``ticker, change``.
    """
    out = events.groupBy("ticker", "event").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days_active"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    out = out.join(change.select("ticker", "change"), "ticker", "left")
    return out.withColumn("uncertainty", content_reasons({"single_source": F.size("sources") == 1, "low_confidence": F.coalesce("confidence", F.lit(0.0)) < 0.5, "no_prior_sentiment": F.col("change").isNull()}))
