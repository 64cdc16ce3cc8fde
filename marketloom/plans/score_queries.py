"""Queries of article, event and symbol scores; events stand for articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import scoring as sc
from marketloom.operators import timeseries as ts
from marketloom.plans.registry import query, table
from marketloom.plans.series_queries import EVENTS, PRICES, daily_events, prices


def r(column, digits: int = 6):
    return F.round(column, digits)


@query("""WITH a AS (SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) || event_type AS url, event_type AS publisher, value AS priority, CAST(event_id % 5 AS INTEGER) AS tier, (user_id % 10) / 10.0 AS conf, user_id % 2 = 0 AS direct, CAST(event_id % 15 AS INTEGER) - 3 AS ser FROM events),
  n AS (SELECT *, count(*) OVER (PARTITION BY publisher) AS n, min(id) OVER (PARTITION BY url) AS first FROM a)
  SELECT id, round(priority * 0.22 + CASE tier WHEN 1 THEN 100 WHEN 2 THEN 75 WHEN 3 THEN 40 WHEN 4 THEN 0 ELSE 60 END * 0.18 + CAST(conf AS DOUBLE) * 100 * 0.2 + 100.0 / n * 0.08 + CASE WHEN id = first THEN 100.0 ELSE 0 END * 0.08 + CASE WHEN direct THEN 95.0 ELSE 20 END * 0.14 + greatest(0, least(100, 50 + ser * 3)) * 0.1, 3) AS acquisition FROM n""")
def acquisition_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("url"), F.col("event_type").alias("publisher"), F.col("value").alias("priority"), (F.col("event_id") % 5).cast("int").alias("tier"), (F.col("user_id") % 10 / 10).alias("ticker_confidence"), (F.col("user_id") % 2 == 0).alias("direct"), ((F.col("event_id") % 15).cast("int") - 3).alias("seriousness"))
    return sc.acquisition_scores(rows).select("id", "acquisition")


@query("""SELECT event_id, round(greatest(0, CASE user_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 10 ELSE 0 END + CASE event_type WHEN 'click' THEN 14 WHEN 'view' THEN 10 WHEN 'signup' THEN 8 ELSE 0 END + CASE event_id % 5 WHEN 1 THEN 18 WHEN 2 THEN 10 WHEN 3 THEN 1 WHEN 4 THEN -20 ELSE -3 END
  + least(15.0, (greatest(1, user_id % 6) - 1) * 5) + least(15.0, abs(value / 97) * 50) + CASE WHEN user_id % 7 = 0 THEN 20 ELSE 0 END + CASE WHEN user_id % 11 = 0 THEN 8 ELSE 0 END + (event_id % 15 - 3) - CASE WHEN user_id % 13 = 0 THEN 5 ELSE 0 END - least(18.0, (event_id % 9) * 3)), 2) AS score FROM events""")
def event_priorities(spark, sf_dir):
    u, i = F.col("user_id"), F.col("event_id")
    group = F.when(u % 3 == 0, "portfolio").when(u % 3 == 1, "watchlist").otherwise("none")
    status = F.when(F.col("event_type") == "click", "fuzzy_event_repeat").when(F.col("event_type") == "view", "exact_url_repeat").when(F.col("event_type") == "signup", "likely_new_event").otherwise("other")
    score, _ = sc.event_priority(group, status, (i % 5).cast("int"), u % 6, F.col("value") / 97, u % 7 == 0, u % 11 == 0, i % 15 - 3, u % 13 == 0, i % 9)
    return table(spark, sf_dir, "events").select("event_id", score.alias("score"))


_TECH = """, d AS (SELECT symbol, date, close, close - lag(close) OVER w AS d, lag(close, 20) OVER w AS c20, volume FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  i AS (SELECT symbol, date, close, avg(greatest(d, 0)) OVER w14 AS g, avg(greatest(-d, 0)) OVER w14 AS l, avg(close) OVER w20 AS m20, stddev_samp(close) OVER w20 AS s20, avg(close) OVER w50 AS m50, volume / avg(volume) OVER w20 AS vr, close / c20 - 1 AS mom, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM d
    WINDOW w14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)),
  x AS (SELECT symbol, 100 - 100 / (1 + g / l) AS rsi, (close - (m20 - 2 * s20)) / (4 * s20) AS pos, m20, m50, vr, mom FROM i WHERE r = 1)
  SELECT symbol, round(greatest(-5, least(5, CASE WHEN rsi < 30 THEN 1.5 WHEN rsi > 70 THEN -1.5 ELSE (50 - rsi) / 50 END + (pos - 0.5) * 2 + CASE WHEN m20 > m50 THEN 0.5 ELSE -0.5 END + CASE WHEN vr > 1.5 THEN 0.5 WHEN vr < 0.5 THEN -0.5 ELSE 0 END + greatest(-1, least(1, mom * 5)))), 5) AS score FROM x"""


@query(PRICES + _TECH)
def technical_scores(spark, sf_dir):
    rows = ts.rsi(prices(spark, sf_dir))
    rows = rows.select("symbol", "date", "rsi", ts.bollinger()["band_position"].alias("pos"), ts.sma("close", 20).alias("m20"), ts.sma("close", 50).alias("m50"), F.try_divide(F.col("volume"), ts.full_window(F.avg, "volume", 20)).alias("vr"), ts.ratio_change(F.col("close"), F.lag("close", 20).over(ts.by_symbol())).alias("mom"), F.row_number().over(ts.by_symbol(descending=True)).alias("r"))
    c = F.col
    return rows.where("r = 1").select("symbol", r(sc.technical_score(c("rsi"), F.lit(0.0), c("pos"), c("m20"), c("m50"), c("vr"), c("mom")), 5).alias("score"))


@query("""SELECT s_suppkey, round(greatest(-5, least(5, CASE WHEN pe BETWEEN 10 AND 18 THEN 1 WHEN pe > 25 THEN -1 ELSE 0 END + CASE WHEN pb < 2 THEN 0.5 WHEN pb > 4 THEN -0.5 ELSE 0 END + CASE WHEN roe > 0.15 THEN 1 WHEN roe < 0.08 THEN -1 ELSE 0 END)), 4) AS score
  FROM (SELECT s_suppkey, s_acctbal / 300 AS pe, s_acctbal / 2000 AS pb, s_acctbal / 50000 AS roe FROM supplier)""")
def fundamental_scores(spark, sf_dir):
    b = F.col("s_acctbal")
    score = sc.fundamental_score(b / 300, b / 2000, F.lit(0.5), b / 50000, F.lit(0.05), F.lit(0.05))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r(score, 4).alias("score"))


@query("""WITH s AS (SELECT event_id, greatest(-5, least(5, (value - 10) / 10 * 0.4 + (user_id % 11 - 5) * 0.35 + (event_id % 7 - 3) * 0.25 + CASE WHEN value > 40 THEN -1 WHEN user_id % 2 = 0 THEN -0.5 ELSE 0 END * 0.2)) AS f FROM events)
  SELECT event_id, round(f, 5) AS fusion, CASE WHEN f >= 2 THEN 'strong_buy' WHEN f >= 1 THEN 'buy' WHEN f <= -2 THEN 'strong_sell' WHEN f <= -1 THEN 'sell' ELSE 'hold' END AS action FROM s""")
def fusion_actions(spark, sf_dir):
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    f = sc.fusion_score((v - 10) / 10, u % 11 - 5, i % 7 - 3, F.when(v > 40, 0.5).otherwise(0.1), F.when(u % 2 == 0, 0.1).otherwise(1.0), {"sentiment": 0.4, "technical": 0.35, "fundamental": 0.25, "risk": 0.2})
    rows = table(spark, sf_dir, "events").withColumn("fusion", f)
    return rows.select("event_id", r("fusion", 5).alias("fusion"), sc.action(F.col("fusion"), F.lit(1.0), F.lit(-1.0)).alias("action"))


@query(PRICES + " SELECT symbol, round(least(stddev_samp(ret) * sqrt(252) * sqrt(7 / 365.25) * 100, 25), 1) AS implied_move, round(quantile_cont(abs(ret), 0.95) * 100, 1) AS typical_move FROM rets GROUP BY symbol HAVING count(ret) >= 5")
def implied_moves(spark, sf_dir):
    return sc.implied_move(prices(spark, sf_dir))


@query()
def triple_barriers(spark, sf_dir):
    rows = prices(spark, sf_dir)
    return sc.triple_barrier(rows, rows.select("symbol", "date", (F.col("volume") / 10 - 0.3).alias("value")))


_HEAD = r"""WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, lower(regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1)) AS t FROM pages),
  f AS (SELECT page_id, contains(regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', ''), 'example.org') AS p, regexp_matches(u, '/en/') AS o, contains(u, 'sec.gov') OR contains(u, 'edgar') OR contains(t, 'sec filing') AS s, contains(t, 'the') AS w FROM p),
  g AS (SELECT *, p OR o OR s AS known, w AND NOT (p OR o OR s) AS rumour, CASE WHEN p THEN 0.3 ELSE 0 END + CASE WHEN o THEN 0.2 ELSE 0 END + CASE WHEN s THEN 0.25 ELSE 0 END - CASE WHEN w AND NOT (p OR o OR s) THEN 0.2 ELSE 0 END AS boost FROM f)"""


def headlines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1).alias("title"))
    return sc.corroboration(rows, ["example.org"], "/en/", ["the"])


@query(_HEAD + " SELECT page_id, list_filter([CASE WHEN p THEN 'primary_source' END, CASE WHEN o THEN 'official_company' END, CASE WHEN s THEN 'sec_filing' END, CASE WHEN rumour THEN 'speculative' END], lambda x: x IS NOT NULL) AS flags, known AS corroborated, round(CAST(greatest(0, least(1, 0.5 + boost)) AS DOUBLE), 4) AS confidence FROM g")
def corroborated_headlines(spark, sf_dir):
    return headlines(spark, sf_dir).select("page_id", "flags", "corroborated", r("confidence", 4).alias("confidence"))


@query(_HEAD + " SELECT count(*) AS total, count(*) FILTER (known) AS corroborated, round(count(*) FILTER (known) / count(*) * 100, 1) AS corroborated_pct, count(*) FILTER (rumour) AS speculative, count(*) FILTER (p) AS primary_sources FROM g")
def corroboration_stats(spark, sf_dir):
    return sc.corroboration_stats(headlines(spark, sf_dir)).select("total", "corroborated", "corroborated_pct", "speculative", "primary_sources")


@query("""SELECT event_id, CASE WHEN event_type = 'error' OR value / 20 < 0.4 OR (user_id % 10) / 10.0 < 0.3 THEN 'reject' WHEN value / 20 >= 0.6 AND (user_id % 10) / 10.0 >= 0.5 THEN 'publish' ELSE 'review' END AS decision FROM events""")
def publication_decisions(spark, sf_dir):
    decision = sc.publication(F.col("event_type") == "error", F.col("value") / 20, F.col("user_id") % 10 / 10)
    return table(spark, sf_dir, "events").select("event_id", decision.alias("decision"))


@query("""WITH c AS (SELECT event_id AS seq, CASE user_id % 4 WHEN 0 THEN upper(substr(event_type, 1, 4)) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '' ELSE upper(substr(event_type, 1, 3)) || '.' || 'B' END AS symbol FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS nth FROM c)
  SELECT seq, symbol, CASE WHEN symbol = '' THEN 'invalid_type' WHEN NOT regexp_matches(symbol, '^[A-Z]{1,5}([.-][A-Z]{1,2})?$') THEN 'invalid_format' WHEN symbol = 'VIEW' OR nth > 1 THEN 'duplicate' END AS reason FROM n""")
def symbol_intake(spark, sf_dir):
    u, t = F.col("user_id") % 4, F.upper("event_type")
    symbol = F.when(u == 0, F.substring(t, 1, 4)).when(u == 1, F.col("user_id").cast("string")).when(u == 2, "").otherwise(F.concat(F.substring(t, 1, 3), F.lit(".B")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), symbol.alias("symbol"))
    return sc.symbol_intake(rows, spark.createDataFrame([("view",)], "symbol string"))


@query("""WITH a AS (SELECT event_id AS symbol, CASE event_type WHEN 'click' THEN 'buy' WHEN 'view' THEN 'hold' WHEN 'error' THEN 'exit' ELSE 'reduce' END AS action, least(1.0, value / 50) AS confidence FROM events)
  SELECT count(*) AS total, count(*) FILTER (action = 'buy') AS buy, count(*) FILTER (action = 'hold') AS hold, count(*) FILTER (action = 'reduce') AS reduce, count(*) FILTER (action = 'exit') AS exit, round(avg(confidence), 2) AS average_confidence, count(*) FILTER (confidence >= 0.8) AS high_conviction, (SELECT list(symbol ORDER BY confidence DESC, symbol) FROM (SELECT * FROM a ORDER BY confidence DESC, symbol LIMIT 3)) AS top FROM a""")
def recommendation_summary(spark, sf_dir):
    t = F.col("event_type")
    action = F.when(t == "click", "buy").when(t == "view", "hold").when(t == "error", "exit").otherwise("reduce")
    return sc.recommendation_summary(table(spark, sf_dir, "events").select(F.col("event_id").alias("symbol"), action.alias("action"), F.least(F.lit(1.0), F.col("value") / 50).alias("confidence")))


@query("""WITH a AS (SELECT event_id AS id, user_id % 40 AS cluster, 't' || CAST(user_id % 8 AS VARCHAR) AS ticker, (user_id % 10) / 10.0 AS conf, CAST(event_id % 4 + 1 AS INTEGER) AS tier, event_type = 'click' AS direct, value FROM events),
  s AS (SELECT *, round(CAST(conf AS DOUBLE) * 40 + CASE tier WHEN 1 THEN 30 WHEN 2 THEN 22 WHEN 3 THEN 8 ELSE -100 END + 20 + CASE WHEN direct THEN 30 ELSE -20 END + 10 + 3 + 2 + value * 0.15, 4) AS score FROM a WHERE conf > 0 AND tier < 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) AS r FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, id) AS t FROM b WHERE r = 1) SELECT id, ticker, score FROM c WHERE t <= 5 ORDER BY score DESC, id LIMIT 75""")
def extraction_queue(spark, sf_dir):
    u, i = F.col("user_id"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("id"), (u % 40).alias("cluster"), F.concat(F.lit("t"), (u % 8).cast("string")).alias("ticker"), (u % 10 / 10).alias("confidence"), (i % 4 + 1).cast("int").alias("tier"), F.lit("today_signal").alias("bucket"), F.lit(0).alias("seriousness"), (F.col("event_type") == "click").alias("direct"), F.lit(True).alias("primary"), F.lit(False).alias("portfolio"), F.lit(2).alias("diversity"), F.col("value").alias("acquisition"), F.lit(True).alias("fetch_allowed"))
    return sc.extraction_queue(sc.queue_scores(rows)).select("id", "ticker", "score")


@query(r"""WITH s AS (SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) AS k FROM documents) SELECT doc_id, CAST(greatest(0, 10 + CASE WHEN n >= 1600 THEN 30 WHEN n >= 800 THEN 24 WHEN n >= 400 THEN 16 WHEN n >= 220 THEN 8 ELSE -12 END + CASE WHEN k >= 10 THEN 20 WHEN k >= 5 THEN 14 WHEN k >= 3 THEN 8 ELSE -8 END) AS DOUBLE) AS quality FROM s""")
def extraction_quality(spark, sf_dir):
    from marketloom.functions import text as tx

    return table(spark, sf_dir, "documents").select("doc_id", sc.text_quality(F.coalesce("text", F.lit("")), tx.text_counts("text")["n_sentences"]).alias("quality"))


@query(EVENTS + """, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS i FROM daily), g(decay, win) AS (VALUES (0.2, 29), (0.2, 90), (0.94, 29), (0.94, 90))
  SELECT symbol, CAST(decay AS DOUBLE) AS decay, CAST(win AS INTEGER) AS "window", round(sum((1 - decay) * power(CAST(decay AS DOUBLE), i) * value) / sum((1 - decay) * power(CAST(decay AS DOUBLE), i)), 5) AS decayed FROM i, g WHERE i < win GROUP BY 1, 2, 3""")
def parameter_sweep(spark, sf_dir):
    return sc.parameter_sweep(daily_events(spark, sf_dir)).select("symbol", "decay", "window", r("decayed", 5).alias("decayed"))


@query("""WITH a AS (SELECT user_id % 20 AS ticker, ((user_id % 10) / 10.0 - 0.5) * 2 AS s, event_type = 'error' AS dup, event_type AS source FROM events) SELECT ticker, count(*) AS n, round(avg(s), 5) AS mean, count(*) FILTER (s > 0.1) AS positive, count(*) FILTER (s < -0.1) AS negative, count(*) FILTER (dup) AS duplicates, count(DISTINCT source) AS sources FROM a GROUP BY ticker""")
def article_insights(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("ticker"), (F.col("user_id") % 10 / 10).alias("relevance"), (F.col("event_type") == "error").alias("duplicate"), F.lit("publish").alias("decision"), F.col("event_type").alias("source"))
    return sc.article_insights(rows).select("ticker", "n", r("mean", 5).alias("mean"), "positive", "negative", "duplicates", "sources")


@query("""WITH a AS (SELECT doc_id, source, lang FROM documents WHERE lang IS NOT NULL), p AS (SELECT source, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY 1), t AS (SELECT lang, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY 1)
  SELECT doc_id, CASE WHEN p.s > 0.3 THEN round(0.3 / p.s, 4) ELSE 1 END AS provider_factor, CASE WHEN t.s > 0.3 THEN round(0.3 / t.s, 4) ELSE 1 END AS ticker_factor FROM a JOIN p ON a.source = p.source JOIN t ON a.lang = t.lang""")
def concentration_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("ticker"))
    return sc.concentration_weights(rows, 0.3, 0.3).select("doc_id", "provider_factor", "ticker_factor")


@query("""SELECT user_id AS symbol, CAST(ts AS DATE) AS event_date, date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS days_until, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) = 1 AS next FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-29'""")
def upcoming_events(spark, sf_dir):
    days = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("event_date"), "event_id")
    return sc.upcoming(days, "2024-01-15", tie="event_id").select("symbol", "event_date", "days_until", "next")


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice - 200000, 2) AS profit, round(o_totalprice / 200000 - 1, 6) AS profit_pct, round(least(0.5, o_totalprice / 1000000), 6) AS share FROM orders""")
def position_contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(1.0).alias("shares"), F.lit(200000.0).alias("cost"), F.col("o_totalprice").alias("price"))
    out = sc.position_context(rows, 1_000_000.0)
    # rounded as doubles, half away from zero: decimal rounding of their shortest digits differs at ties
    near = lambda c, scale: (F.signum(c) * F.floor(F.abs(F.col(c) * scale) + 0.5) / scale).alias(c)
    return out.select("o_custkey", "o_orderkey", near("profit", 1e2), near("profit_pct", 1e6), near("share", 1e6))


@query("""WITH u AS (SELECT user_id AS key, max(value) AS slowest, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT key, 'slowest' AS metric, slowest AS value, 'warning' AS severity FROM u WHERE slowest > 60 UNION ALL SELECT key, 'errors', CAST(errors AS DOUBLE), 'critical' FROM u WHERE errors > 10""")
def operational_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("slowest"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return sc.operational_alerts(rows, {"slowest": (60, "warning"), "errors": (10, "critical")})


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    tokens, _ = sc.token_estimate(F.col("text"), 3.0)
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))


CATEGORIES = {"companies": (["the", "hand"], 0.4), "markets": (["und", "der"], 0.3), "economics": (["ción", "del"], 0.2), "crypto": (["que"], 0.1)}


def _category(words, weight) -> str:
    return "least(1.0, (" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + f") / {len(words)}.0 * 3) * {weight}"


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE WHEN trim(t) = '' THEN 0 ELSE round(CAST(least(1.0, " + " + ".join(_category(w, x) for w, x in CATEGORIES.values()) + ") AS DOUBLE), 6) END AS relevance FROM d")
def keyword_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r(sc.keyword_relevance(F.col("text"), CATEGORIES)).alias("relevance"))


@query("""WITH s AS (SELECT event_id, CASE WHEN value > 15 THEN 2 ELSE 0 END + CASE WHEN user_id % 5 > 3 THEN 2 ELSE 0 END + CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS up,
  CASE WHEN value < 5 THEN 2 ELSE 0 END + CASE WHEN user_id % 5 < 1 THEN 2 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS down,
  CASE WHEN value <= 15 AND value >= 5 THEN 1 ELSE 0 END + CASE WHEN user_id % 5 BETWEEN 1 AND 3 THEN 1 ELSE 0 END + CASE WHEN event_type NOT IN ('click', 'view') THEN 1 ELSE 0 END + CASE WHEN user_id % 7 = 0 THEN 2 ELSE 0 END AS unsure FROM events)
  SELECT event_id, CASE WHEN unsure >= 3 OR abs(up - down) <= 1 THEN 'Big Swing Unsure' WHEN up > down THEN 'Up' ELSE 'Down' END AS prediction, CASE WHEN unsure >= 3 OR abs(up - down) <= 1 THEN 0.4 ELSE least(0.9, round(0.5 + abs(up - down) * 0.1, 2)) END AS confidence FROM s""")
def direction_votes(spark, sf_dir):
    u, v, t = F.col("user_id"), F.col("value"), F.col("event_type")
    prediction, confidence = sc.direction_vote((v - 10) / 100, (u % 5 - 2) * 0.1, (u % 3 - 1) * 0.05, F.when(t == "click", "bullish").when(t == "view", "bearish").otherwise("none"), u % 7 == 0, F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", prediction.alias("prediction"), confidence.alias("confidence"))


@query("""WITH e AS (SELECT 't' || CAST(user_id % 30 AS VARCHAR) AS ticker, event_type AS event, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS source, (user_id % 10) / 10.0 AS confidence FROM events), c AS (SELECT 't' || CAST(user_id % 30 AS VARCHAR) AS ticker FROM events WHERE user_id % 30 < 20 GROUP BY 1)
  SELECT e.ticker, event, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days_active, count(*) AS n, list_filter([CASE WHEN count(DISTINCT source) = 1 THEN 'single_source' END, CASE WHEN max(confidence) < 0.5 THEN 'low_confidence' END, CASE WHEN any_value(c.ticker) IS NULL THEN 'no_prior_sentiment' END], lambda x: x IS NOT NULL) AS uncertainty FROM e LEFT JOIN c ON e.ticker = c.ticker GROUP BY 1, 2""")
def briefing_packets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 30).cast("string")).alias("ticker"), (F.col("user_id") % 30).alias("k"), F.col("event_type").alias("event"), F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("source"), (F.col("user_id") % 10 / 10).alias("confidence"))
    change = e.where("k < 20").select("ticker", F.lit(0.1).alias("change")).distinct()
    return sc.briefing_packets(e, change).select("ticker", "event", "first_day", "last_day", "days_active", "n", "uncertainty")


@query("""WITH q AS (SELECT doc_id, least(1.0, n_chars / 5000.0) AS size, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.3 ELSE 0.6 END AS lang FROM documents), o AS (SELECT CAST(size AS DOUBLE) * 0.7 + CAST(lang AS DOUBLE) * 0.3 AS overall, size < 0.4 AS s, lang < 0.4 AS l FROM q),
  t AS (SELECT * FROM (VALUES ('size', (SELECT count(*) FROM o WHERE s)), ('language', (SELECT count(*) FROM o WHERE l))) AS v(issue, n) WHERE n > 0)
  SELECT count(*) AS n, round(avg(overall), 5) AS mean, round(stddev_pop(overall), 5) AS std, (SELECT list(issue ORDER BY n DESC, issue) FROM t) AS top_issues FROM o""")
def quality_summary(spark, sf_dir):
    size, lang = F.least(F.lit(1.0), F.col("n_chars") / 5000), F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.3).otherwise(0.6)
    rows = table(spark, sf_dir, "documents").withColumns(sc.overall_quality({"size": (size, 0.7), "language": (lang, 0.3)}))
    return sc.quality_summary(rows).select("n", r("mean", 5).alias("mean"), r("std", 5).alias("std"), "top_issues")


@query()
def term_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r(sc.term_relevance(F.col("text"), F.substring("text", 1, 80), "hand", "one", ["the", "thing"])).alias("relevance"))
