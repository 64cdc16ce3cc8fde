"""Time-series queries; daily order prices by priority stand for price histories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.operators import graph, portfolio
from marketloom.operators import timeseries as ts
from marketloom.plans.registry import query, table

PRICES = """
WITH prices AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2),
rets AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM prices),
market AS (SELECT date, avg(ret) AS market_ret FROM rets WHERE ret IS NOT NULL GROUP BY date)"""
EVENTS = """
WITH daily AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderkey")
    price = F.col("o_totalprice")
    return rows.groupBy("symbol", "date").agg(F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "o_orderkey").alias("close"), F.count("*").alias("volume"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).select("symbol", "date", "close", ts.simple_return().alias("ret"))


def market(rets: DataFrame) -> DataFrame:
    return rets.where("ret is not null").groupBy("date").agg(F.avg("ret").alias("market_ret"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), "value", "event_id")
    return rows.groupBy("symbol", "date").agg(F.count("*").cast("double").alias("n"), F.max_by("value", "event_id").alias("value"))


def r(column, digits: int = 6):
    return F.round(column, digits)


@query(PRICES + " SELECT symbol, date, round(ret, 6) AS ret FROM rets")
def daily_returns(spark, sf_dir):
    return returns(spark, sf_dir).select("symbol", "date", r("ret").alias("ret"))


@query(PRICES + """ SELECT symbol, date, CASE WHEN count(close) OVER w20 = 20 THEN round(avg(close) OVER w20, 6) END AS sma_20,
  CASE WHEN count(close) OVER w50 = 50 THEN round(avg(close) OVER w50, 6) END AS sma_50, CASE WHEN count(close) OVER w200 = 200 THEN round(avg(close) OVER w200, 6) END AS sma_200,
  round(coalesce(stddev_samp(ret) OVER w5, 0), 6) AS volatility_5 FROM rets
  WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)""")
def moving_averages(spark, sf_dir):
    rows = returns(spark, sf_dir)
    return rows.select("symbol", "date", *(r(ts.sma("close", n)).alias(f"sma_{n}") for n in (20, 50, 200)), r(ts.rolling_volatility("ret", 5)).alias("volatility_5"))


@query(PRICES + """, d AS (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM prices),
  g AS (SELECT symbol, date, CASE WHEN count(d) OVER w = 14 THEN avg(greatest(d, 0)) OVER w END AS g, CASE WHEN count(d) OVER w = 14 THEN avg(greatest(-d, 0)) OVER w END AS l FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
  SELECT symbol, date, round(CASE WHEN g = 0 AND l = 0 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM g""")
def rsi14(spark, sf_dir):
    return ts.rsi(prices(spark, sf_dir)).select("symbol", "date", r("rsi", 4).alias("rsi"))


@query(PRICES + """, b AS (SELECT symbol, date, close, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w = 20 THEN stddev_samp(close) OVER w END AS s,
  CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END AS v, volume, lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS c20 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
  SELECT symbol, date, round(m - 2 * s, 4) AS band_low, round(m + 2 * s, 4) AS band_high, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) AS band_position, round(volume / v, 6) AS volume_ratio, round(close / c20 - 1, 6) AS momentum_20 FROM b""")
def bollinger_bands(spark, sf_dir):
    bands = ts.bollinger()
    rows = prices(spark, sf_dir)
    ratio = F.try_divide(F.col("volume"), ts.full_window(F.avg, "volume", 20))
    momentum = ts.ratio_change(F.col("close"), F.lag("close", 20).over(ts.by_symbol()))
    return rows.select("symbol", "date", r(bands["band_low"], 4).alias("band_low"), r(bands["band_high"], 4).alias("band_high"), r(bands["band_position"]).alias("band_position"), r(ratio).alias("volume_ratio"), r(momentum).alias("momentum_20"))


_PERIODS = {"r_21": 21, "r_63": 63, "r_126": 126, "r_252": 252}


@query(PRICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM prices),
  a AS (SELECT symbol, max(close) FILTER (r = 1) AS last, arg_min(close, date) AS first, max(close) FILTER (r = 21) AS c21, max(close) FILTER (r = 63) AS c63, max(close) FILTER (r = 126) AS c126, max(close) FILTER (r = 252) AS c252 FROM k GROUP BY symbol)
  SELECT symbol, round(last / coalesce(c21, first) - 1, 6) AS r_21, round(last / coalesce(c63, first) - 1, 6) AS r_63, round(last / coalesce(c126, first) - 1, 6) AS r_126, round(last / coalesce(c252, first) - 1, 6) AS r_252 FROM a""")
def benchmark_periods(spark, sf_dir):
    out = ts.period_returns(prices(spark, sf_dir), _PERIODS)
    return out.select("symbol", *(r(c).alias(c) for c in _PERIODS))


@query(PRICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM rets)
  SELECT symbol, max(close) FILTER (r = 1) AS last_close, round(max(close) FILTER (r = 1) / max(close) FILTER (r = 2) - 1, 6) AS change_1, round(max(close) FILTER (r = 1) / max(close) FILTER (r = 6) - 1, 6) AS change_5,
  round(max(close) FILTER (r = 1) / max(close) FILTER (r = 31) - 1, 6) AS change_30, round(stddev_samp(ret), 6) AS volatility, max(close) AS high, min(close) AS low FROM k GROUP BY symbol""")
def price_snapshot(spark, sf_dir):
    out = ts.snapshot(prices(spark, sf_dir))
    return out.select("symbol", "last_close", *(r(c).alias(c) for c in ("change_1", "change_5", "change_30", "volatility")), "high", "low")


_RECENT = """, lim AS (SELECT symbol, max(date) AS last FROM rets GROUP BY symbol),
  near AS (SELECT r.symbol, r.date, r.ret FROM rets r JOIN lim l ON r.symbol = l.symbol AND r.date >= l.last - 365 WHERE ret IS NOT NULL),
  ok AS (SELECT date FROM near GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM near)),
  al AS (SELECT near.* FROM near JOIN ok USING (date)),
  pairs AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, corr(a.ret, b.ret) AS corr, count(*) AS n FROM al a JOIN al b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2)"""


def correlations(spark, sf_dir) -> DataFrame:
    rets = returns(spark, sf_dir).where("ret is not null")
    return ts.pair_correlations(ts.aligned_returns(ts.lookback(rets, 365, 30)))


@query(PRICES + _RECENT + " SELECT sym_i, sym_j, round(corr, 6) AS corr, n FROM pairs")
def pair_correlation(spark, sf_dir):
    return correlations(spark, sf_dir).select("sym_i", "sym_j", r("corr").alias("corr"), "n")


@query(PRICES + _RECENT + """, bth AS (SELECT sym_i AS s, sym_j AS t, corr FROM pairs UNION ALL SELECT sym_j, sym_i, corr FROM pairs)
  SELECT t AS symbol, round(corr, 6) AS corr, CAST(row_number() OVER (ORDER BY corr DESC, t) AS INTEGER) AS rank FROM bth WHERE s = '1-URGENT'""")
def symbol_correlations(spark, sf_dir):
    pairs = correlations(spark, sf_dir)
    one = portfolio.correlations_of(pairs, "1-URGENT")
    return one.select("symbol", r("corr").alias("corr"), F.row_number().over(Window.orderBy(F.desc("corr"), "symbol")).alias("rank"))


@query(PRICES + _RECENT + """, cells AS (SELECT corr FROM pairs UNION ALL SELECT corr FROM pairs)
  SELECT round(avg(corr), 6) AS mean, round(quantile_cont(corr, 0.5), 6) AS median, round(stddev_pop(corr), 6) AS std, round(min(corr), 6) AS low, round(max(corr), 6) AS high,
  (SELECT arg_max(sym_i || '~' || sym_j, corr) FROM pairs) AS highest, (SELECT arg_min(sym_i || '~' || sym_j, corr) FROM pairs) AS lowest FROM cells""")
def correlation_stats(spark, sf_dir):
    stats = portfolio.correlation_stats(correlations(spark, sf_dir))
    return stats.select(*(r(c).alias(c) for c in ("mean", "median", "std", "low", "high")), "highest", "lowest")


@query(PRICES + """, k AS (SELECT r.symbol, r.ret, m.market_ret, row_number() OVER (PARTITION BY r.symbol ORDER BY r.date DESC) AS r FROM rets r JOIN market m ON r.date = m.date WHERE r.ret IS NOT NULL)
  SELECT symbol, round(regr_slope(ret, market_ret), 6) AS beta, round(regr_intercept(ret, market_ret) * 252, 6) AS alpha, round(regr_r2(ret, market_ret), 6) AS r2, round(corr(ret, market_ret), 6) AS corr,
  round(stddev_samp(ret) * sqrt(252), 6) AS volatility, round(stddev_samp(ret - market_ret) * sqrt(252), 6) AS tracking_error, count(*) AS n FROM k WHERE r <= 252 GROUP BY symbol HAVING count(*) >= 30""")
def beta_vs_market(spark, sf_dir):
    rets = returns(spark, sf_dir)
    out = ts.beta_table(rets, market(rets))
    return out.select("symbol", *(r(c).alias(c) for c in ("beta", "alpha", "r2", "corr", "volatility", "tracking_error")), "n")


@query(PRICES + """, c AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM prices),
  p AS (SELECT symbol, unnest([21, 63]) AS period FROM (SELECT DISTINCT symbol FROM c)),
  v AS (SELECT p.symbol, p.period, a.close / b.close - 1 AS x FROM p JOIN c a ON a.symbol = p.symbol AND a.r = 1 JOIN c b ON b.symbol = p.symbol AND b.r = p.period)
  SELECT t.symbol, b.symbol AS benchmark, CAST(t.period AS INTEGER) AS period, round(t.x - b.x, 6) AS excess FROM v t JOIN v b ON t.period = b.period AND t.symbol <> b.symbol""")
def excess_performance(spark, sf_dir):
    wide = ts.period_returns(prices(spark, sf_dir), {"p21": 21, "p63": 63})
    out = portfolio.excess_performance(wide, {"p21": 21, "p63": 63})
    return out.select("symbol", "benchmark", "period", r("excess").alias("excess"))


@query(PRICES + """, w AS (SELECT symbol, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM rets),
  p AS (SELECT *, max(wealth) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM w) SELECT symbol, date, round(wealth / peak - 1, 6) AS drawdown FROM p""")
def drawdown_curve(spark, sf_dir):
    return ts.drawdown(returns(spark, sf_dir)).select("symbol", "date", r("drawdown").alias("drawdown"))


@query(PRICES + " SELECT symbol, round((avg(ret) * 252 - 0.02) / (stddev_samp(ret) * sqrt(252)), 6) AS sharpe, round(quantile_cont(ret, 0.05), 6) AS var_95, count(ret) AS n FROM rets GROUP BY symbol")
def sharpe_var(spark, sf_dir):
    return ts.risk_table(returns(spark, sf_dir)).select("symbol", r("sharpe").alias("sharpe"), r("var_95").alias("var_95"), "n")


@query(PRICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM rets),
  s AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS v, exp(sum(ln(1 + ret)) FILTER (r <= 30)) - 1 AS m FROM k GROUP BY symbol)
  SELECT symbol, round(v, 6) AS volatility, round(m, 6) AS return_30, CASE WHEN v > 0.25 THEN 'high_volatility' WHEN m > 0.05 THEN 'bull' WHEN m < -0.05 THEN 'bear' ELSE 'sideways' END AS regime FROM s""")
def market_regimes(spark, sf_dir):
    return ts.market_regime(returns(spark, sf_dir)).select("symbol", r("volatility").alias("volatility"), r("return_30").alias("return_30"), "regime")


_A7 = 1 - math.exp(-math.log(2) / 7)


@query(EVENTS + f""", i AS (SELECT symbol, date, value, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM daily)
  SELECT a.symbol, a.date, round(sum(b.value * power({1 - _A7!r}, a.i - b.i)) / sum(power({1 - _A7!r}, a.i - b.i)), 6) AS ewma FROM i a JOIN i b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2""")
def ewm_sentiment(spark, sf_dir):
    out = ts.ewma(daily_events(spark, sf_dir), {"ewma": ("value", ts.alpha_of(halflife=7))})
    return out.select("symbol", "date", r("ewma").alias("ewma"))


def _ewma_sql(value: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    return f"sum(b.{value} * power({keep!r}, a.i - b.i)) / sum(power({keep!r}, a.i - b.i))"


@query(EVENTS + f""", i AS (SELECT symbol, date, n AS close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM daily),
  l AS (SELECT a.symbol, a.date, a.i, {_ewma_sql('close', 12)} - {_ewma_sql('close', 26)} AS macd FROM i a JOIN i b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2, 3)
  SELECT a.symbol, a.date, round(any_value(a.macd), 6) AS macd, round(any_value(a.macd) - {_ewma_sql('macd', 9)}, 6) AS macd_hist FROM l a JOIN l b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2""")
def ewma_macd(spark, sf_dir):
    rows = daily_events(spark, sf_dir).select("symbol", "date", F.col("n").alias("close"))
    return ts.macd(rows).select("symbol", "date", r("macd").alias("macd"), r("macd_hist").alias("macd_hist"))


@query(EVENTS + """, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS i FROM daily)
  SELECT symbol, round(sum(0.8 * power(0.2, i) * value) / sum(0.8 * power(0.2, i)), 6) AS decayed FROM i GROUP BY symbol""")
def decayed_sentiment(spark, sf_dir):
    rows = daily_events(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    return ts.decayed_mean(rows, "value", "confidence").select("symbol", r("decayed").alias("decayed"))


@query(EVENTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM daily)
  SELECT symbol, round(avg(value) FILTER (r > c // 2) - avg(value) FILTER (r <= c // 2) + 1e-9, 6) AS trend FROM k GROUP BY symbol""")
def sentiment_trend(spark, sf_dir):
    return ts.half_trend(daily_events(spark, sf_dir), "value").select("symbol", r(F.col("trend") + 1e-9).alias("trend"))


@query(EVENTS + """, k AS (SELECT symbol, n, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM daily), s AS (SELECT symbol, avg(n) AS mean, quantile_cont(n, 0.5) AS median, regr_slope(n, i) AS slope FROM k GROUP BY symbol)
  SELECT symbol, round(mean + 1e-9, 4) AS mean, round(median + 1e-9, 4) AS median, round(slope, 6) AS slope, CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def trend_slope(spark, sf_dir):
    return ts.slope_trend(daily_events(spark, sf_dir), "n").select("symbol", r(F.col("mean") + 1e-9, 4).alias("mean"), r(F.col("median") + 1e-9, 4).alias("median"), r("slope").alias("slope"), "trend")


@query(PRICES + """, z AS (SELECT symbol, date, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
  y AS (SELECT symbol, date, CASE WHEN n >= 10 AND s > 0 THEN (close - m) / s END AS z FROM z) SELECT symbol, date, round(z, 5) AS z, coalesce(abs(z) > 3, false) AS anomaly FROM y""")
def zscore_anomaly(spark, sf_dir):
    return ts.zscore_anomalies(prices(spark, sf_dir), "close").select("symbol", "date", r("z", 5).alias("z"), "anomaly")


@query(PRICES + """, c AS (SELECT *, close / lag(close) OVER w - 1 AS ch, open / lag(close) OVER w - 1 AS gap FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  a AS (SELECT *, avg(volume) OVER p AS av, avg(ch) OVER p AS ac, stddev_samp(ch) OVER p AS sc FROM c WINDOW p AS (PARTITION BY symbol))
  SELECT symbol, date, coalesce(abs(ch) > 0.5, false) AS big_change, coalesce(abs(gap) > 0.2, false) AS big_gap, (high < low OR close > high OR close < low) AS bad_range, volume > 10 * av AS big_volume, coalesce(abs(ch - ac) > 3 * sc, false) AS outlier FROM a""")
def ohlc_plausibility(spark, sf_dir):
    return ts.plausibility(prices(spark, sf_dir))


@query(PRICES + """, e AS (SELECT date, arg_max(market_ret, date) AS s FROM market WHERE extract('dow' FROM date) = 1 GROUP BY date)
  SELECT p.symbol, p.date, coalesce(e.s, 0) AS sentiment FROM (SELECT p.symbol, p.date, max(e.date) AS d FROM prices p LEFT JOIN e ON e.date <= p.date GROUP BY 1, 2) p LEFT JOIN e ON e.date = p.d""".replace("coalesce(e.s, 0)", "round(coalesce(e.s, 0), 6)"))
def asof_sentiment(spark, sf_dir):
    rets = returns(spark, sf_dir)
    symbols = rets.select("symbol").distinct()
    facts = market(rets).where(F.dayofweek("date") == 2).join(symbols).select("symbol", "date", F.col("market_ret").alias("sentiment"))
    return ts.asof_join(prices(spark, sf_dir).select("symbol", "date"), facts, "sentiment", 0.0).select("symbol", "date", r("sentiment").alias("sentiment"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS stock FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS market FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
  j AS (SELECT coalesce(a.date, b.date) AS date, stock, market FROM a FULL JOIN b ON a.date = b.date)
  SELECT date, last_value(stock IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS stock, last_value(market IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS market FROM j""")
def outer_merge_ffill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    a = orders.where("o_orderpriority = '1-URGENT'").groupBy("date").agg(F.max("o_totalprice").alias("stock"))
    b = orders.where("o_orderstatus = 'P'").groupBy("date").agg(F.max("o_totalprice").alias("market"))
    both = a.join(b, "date", "full").withColumn("symbol", F.lit("merged"))
    return both.select("date", ts.forward_filled("stock").alias("stock"), ts.forward_filled("market").alias("market"))


@query(PRICES + """, l AS (SELECT symbol, max(date) AS last FROM rets GROUP BY symbol), k AS (SELECT r.*, date >= last - 5 AS inside, row_number() OVER (PARTITION BY r.symbol ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY r.symbol) AS n FROM rets r JOIN l ON r.symbol = l.symbol),
  c AS (SELECT *, sum(CAST(inside AS INTEGER)) OVER (PARTITION BY symbol) AS k FROM k) SELECT symbol, date, close FROM c WHERE CASE WHEN k < 10 AND n >= 10 THEN r <= 10 ELSE inside END""")
def trailing_days(spark, sf_dir):
    return ts.last_days(returns(spark, sf_dir), 5).select("symbol", "date", "close")


@query(PRICES + """, k AS (SELECT symbol, date, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS w FROM prices) SELECT symbol, date, round(list_sum(w), 4) AS total, w[1] AS oldest, w[20] AS newest FROM k WHERE len(w) = 20""")
def sequence_windows(spark, sf_dir):
    rows = ts.sliding_windows(prices(spark, sf_dir), "close")
    return rows.select("symbol", "date", r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.col("window")[0].alias("oldest"), F.col("window")[19].alias("newest"))


@query(PRICES + """, t AS (SELECT symbol, date, close, lead(close, 1) OVER w AS t1, lead(close, 2) OVER w AS t2, lead(close, 3) OVER w AS t3, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS f FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, round(avg((abs(t1 - f) + abs(t2 - f) + abs(t3 - f)) / 3), 3) AS mae, round(sqrt(avg((power(t1 - f, 2) + power(t2 - f, 2) + power(t3 - f, 2)) / 3)), 3) AS rmse, count(*) AS n FROM t WHERE t3 IS NOT NULL GROUP BY symbol""")
def rolling_backtest(spark, sf_dir):
    rows = ts.backtest_truth(prices(spark, sf_dir).withColumn("forecast", F.avg("close").over(ts.trailing(10))))
    errors = [F.col(f"truth_{k}") - F.col("forecast") for k in (1, 2, 3)]
    mean = lambda xs: sum(xs[1:], xs[0]) / 3
    return rows.groupBy("symbol").agg(r(F.avg(mean([F.abs(e) for e in errors])), 3).alias("mae"), r(F.sqrt(F.avg(mean([e * e for e in errors]))), 3).alias("rmse"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT r_name AS sector, sum(v) AS v FROM c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT sector, round(v / sum(v) OVER (), 6) AS weight FROM s""")
def sector_allocation(spark, sf_dir):
    holdings = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("symbol")).agg(F.sum("c_acctbal").alias("value"))
    sectors = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("symbol"), F.col("r_name").alias("sector"))
    return portfolio.allocation(holdings, sectors).select("sector", r("weight").alias("weight"))


@query(PRICES + _RECENT + """, e AS (SELECT sym_i AS a, sym_j AS b, corr FROM pairs WHERE abs(corr) >= 0.02), bth AS (SELECT a AS node, corr AS w FROM e UNION ALL SELECT b, corr FROM e), nodes AS (SELECT DISTINCT symbol AS node FROM al),
  d AS (SELECT nodes.node, coalesce(count(w) FILTER (w > 0), 0) AS degree FROM nodes LEFT JOIN bth ON nodes.node = bth.node GROUP BY 1)
  SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree, max(degree) AS max_degree, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1) / 2), 6) AS density FROM d""")
def corr_graph_stats(spark, sf_dir):
    pairs = correlations(spark, sf_dir)
    nodes = pairs.select(F.col("sym_i").alias("node")).union(pairs.select("sym_j")).distinct()
    out = graph.statistics(nodes, graph.threshold_edges(pairs, 0.02))
    return out.select("n_nodes", "n_edges", r("mean_degree").alias("mean_degree"), r("std_degree").alias("std_degree"), "max_degree", r("density").alias("density"))


@query("SELECT a.n_name AS node_i, b.n_name AS node_j, r_name AS sector FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON a.n_regionkey = r_regionkey")
def sector_edges(spark, sf_dir):
    members = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("sector"))
    return graph.sector_edges(members)
