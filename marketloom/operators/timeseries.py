"""Time-series operators on long price frames ``symbol, date, close, ...``.

Every function keeps one row per (symbol, date) and partitions by symbol, so
the work is spread over symbols; a series must fit one task, which even a
century of minutes does. Missing values are NULL. ``std`` is the sample
deviation unless it says population.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SYMBOL, DATE = "symbol", "date"


def by_symbol(descending: bool = False):
    return Window.partitionBy(SYMBOL).orderBy(F.desc(DATE) if descending else F.asc(DATE))


def trailing(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def ratio_change(now, before) -> Column:
    """``now / before - 1``; null where ``before`` is zero or missing."""
    return F.try_divide(now, before) - 1


def simple_return(value: str = "close") -> Column:
    return ratio_change(F.col(value), F.lag(value).over(by_symbol()))


def forward_filled(value: str) -> Column:
    return F.last(value, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def full_window(aggregate, value: str, n: int) -> Column:
    """An aggregate over the last ``n`` rows, null until there are that many values."""
    frame = trailing(n)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def sma(value: str, n: int) -> Column:
    return full_window(F.avg, value, n)


def rolling_volatility(value: str, n: int = 5) -> Column:
    """Rolling deviation with one observation enough; the first is 0."""
    return F.coalesce(F.stddev_samp(value).over(trailing(n)), F.lit(0.0))


def rsi(prices: DataFrame, n: int = 14, value: str = "close", out: str = "rsi") -> DataFrame:
    """Relative strength from simple rolling means; 100 where nothing was lost, null where nothing moved."""
    moved = prices.withColumn("_d", F.col(value) - F.lag(value).over(by_symbol()))
    moved = moved.withColumns({"_gain": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d").isNotNull(), 0.0), "_loss": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})
    gain, loss = full_window(F.avg, "_gain", n), full_window(F.avg, "_loss", n)
    both = moved.withColumns({"_g": gain, "_l": loss})
    value = F.when((F.col("_l") == 0) & (F.col("_g") == 0), F.lit(None)).when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l")))
    return both.withColumn(out, value).drop("_d", "_gain", "_loss", "_g", "_l")


def alpha_of(span: float | None = None, halflife: float | None = None) -> float:
    return 2 / (span + 1) if span else 1 - math.exp(-math.log(2) / halflife)


def ewma(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Exponentially weighted means ``{out: (value, alpha)}`` with all weights renormalised.

    One pass over each series in order: a recurrence that windows can't state.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])

    def one(pdf):
        pdf = pdf.sort_values(DATE)
        for out, (value, alpha) in columns.items():
            pdf[out] = pdf[value].ewm(alpha=alpha, adjust=True).mean()
        return pdf

    return df.groupBy(SYMBOL).applyInPandas(one, schema)


def ewm_std(df: DataFrame, value: str, span: float, out: str) -> DataFrame:
    """Exponentially weighted sample deviation (bias corrected)."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def one(pdf):
        pdf = pdf.sort_values(DATE)
        pdf[out] = pdf[value].ewm(span=span, adjust=True).std()
        return pdf

    return df.groupBy(SYMBOL).applyInPandas(one, schema)


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``macd``, ``macd_signal``, ``macd_hist`` from EWMAs of ``close``."""
    lines = ewma(prices, {"_fast": ("close", alpha_of(fast)), "_slow": ("close", alpha_of(slow))})
    lines = lines.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewma(lines, {"macd_signal": ("macd", alpha_of(signal))}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def decayed_mean(df: DataFrame, value: str, weight: str, decay: float = 0.2) -> DataFrame:
    """Per symbol: sum of weights ``(1-decay) decay^i`` from the newest row, normalised, times a confidence."""
    ranked = df.withColumn("_i", F.row_number().over(by_symbol(descending=True)) - 1)
    w = F.lit(1 - decay) * F.pow(F.lit(decay), F.col("_i"))
    return ranked.groupBy(SYMBOL).agg(F.try_divide(F.sum(w * F.col(value) * F.col(weight)), F.sum(w)).alias("decayed"))


def bollinger(value: str = "close", n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mean, std = full_window(F.avg, value, n), full_window(F.stddev_samp, value, n)
    return {"band_low": mean - k * std, "band_high": mean + k * std, "band_position": F.try_divide(F.col(value) - (mean - k * std), 2 * k * std)}


def period_returns(prices: DataFrame, periods: dict[str, int]) -> DataFrame:
    """Per symbol, the change since the row so many from the end, else since the first row."""
    ranked = prices.select(SYMBOL, DATE, "close", F.row_number().over(by_symbol(descending=True)).alias("_r"))
    last, first = F.max_by("close", F.when(F.col("_r") == 1, 1)), F.min_by("close", DATE)
    out = [ratio_change(last, F.coalesce(F.max(F.when(F.col("_r") == n, F.col("close"))), first)).alias(name) for name, n in periods.items()]
    return ranked.groupBy(SYMBOL).agg(*out)


def snapshot(prices: DataFrame) -> DataFrame:
    """Price card: last close, changes over 1, 5 and 30 rows, volatility of returns, high and low."""
    ranked = prices.select(SYMBOL, DATE, "close", simple_return().alias("_ret"), F.row_number().over(by_symbol(descending=True)).alias("_r"))
    at = lambda n: F.max(F.when(F.col("_r") == n, F.col("close")))
    return ranked.groupBy(SYMBOL).agg(
        at(1).alias("last_close"), ratio_change(at(1), at(2)).alias("change_1"), ratio_change(at(1), at(6)).alias("change_5"), ratio_change(at(1), at(31)).alias("change_30"),
        F.stddev_samp("_ret").alias("volatility"), F.max("close").alias("high"), F.min("close").alias("low"),
    )


def lookback(prices: DataFrame, days: int, min_points: int) -> DataFrame:
    """Rows within so many days of the symbol's own last date, of symbols with enough of them."""
    last = F.max(DATE).over(Window.partitionBy(SYMBOL))
    recent = prices.withColumn("_last", last).where(F.col(DATE) >= F.date_sub("_last", days)).drop("_last")
    return recent.withColumn("_n", F.count("*").over(Window.partitionBy(SYMBOL))).where(F.col("_n") >= min_points).drop("_n")


def aligned_returns(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Only the dates on which every symbol has a value (listwise deletion)."""
    present = returns.where(F.col(value).isNotNull())
    symbols = present.agg(F.countDistinct(SYMBOL).alias("_all"))
    dates = present.groupBy(DATE).agg(F.countDistinct(SYMBOL).alias("_n")).join(F.broadcast(symbols), F.col("_n") == F.col("_all")).select(DATE)
    return present.join(dates, DATE, "left_semi")


def pair_correlations(returns: DataFrame, value: str = "ret") -> DataFrame:
    """``sym_i, sym_j, corr, n`` with ``sym_i < sym_j``, from rows joined by date."""
    a = returns.select(DATE, F.col(SYMBOL).alias("sym_i"), F.col(value).alias("_x"))
    b = returns.select(DATE, F.col(SYMBOL).alias("sym_j"), F.col(value).alias("_y"))
    return a.join(b, (a[DATE] == b[DATE]) & (F.col("sym_i") < F.col("sym_j"))).groupBy("sym_i", "sym_j").agg(F.corr("_x", "_y").alias("corr"), F.count("*").alias("n"))


def beta_table(returns: DataFrame, market: DataFrame, window: int = 252, min_points: int = 30) -> DataFrame:
    """Beta, alpha, R2, correlation, annualised volatility and tracking error over the last aligned rows."""
    both = returns.join(market, DATE).where(F.col("ret").isNotNull() & F.col("market_ret").isNotNull())
    both = both.withColumn("_r", F.row_number().over(by_symbol(descending=True))).where(F.col("_r") <= window)
    year = math.sqrt(252)
    stats = both.groupBy(SYMBOL).agg(
        F.regr_slope("ret", "market_ret").alias("beta"), (F.regr_intercept("ret", "market_ret") * 252).alias("alpha"), F.regr_r2("ret", "market_ret").alias("r2"), F.corr("ret", "market_ret").alias("corr"),
        (F.stddev_samp("ret") * year).alias("volatility"), (F.stddev_samp(F.col("ret") - F.col("market_ret")) * year).alias("tracking_error"), F.count("*").alias("n"),
    )
    return stats.where(F.col("n") >= min_points)


def drawdown(returns: DataFrame, value: str = "ret") -> DataFrame:
    """``wealth``, ``peak`` and ``drawdown`` of compounded returns; a loss of everything is 0 from there on."""
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(value, F.lit(0.0))
    ruined = F.max(F.when(r <= -1, 1).otherwise(0)).over(upto)
    wealth = F.when(ruined == 1, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest(1 + r, F.lit(1e-300)))).over(upto)))
    wealthy = returns.withColumn("wealth", wealth)
    return wealthy.withColumn("peak", F.max("wealth").over(upto)).withColumn("drawdown", F.try_divide(F.col("wealth"), F.col("peak")) - 1)


def risk_table(returns: DataFrame, risk_free: float = 0.02, value: str = "ret") -> DataFrame:
    """Annualised Sharpe ratio and the 5 % quantile of returns."""
    return returns.groupBy(SYMBOL).agg(
        F.try_divide(F.avg(value) * 252 - risk_free, F.stddev_samp(value) * math.sqrt(252)).alias("sharpe"), F.percentile(value, F.lit(0.05)).alias("var_95"), F.count(value).alias("n"))


def market_regime(returns: DataFrame, high_vol: float = 0.25, move: float = 0.05, value: str = "ret") -> DataFrame:
    """``high_volatility``, else ``bull``, ``bear`` or ``sideways`` by the compounded last 30 rows."""
    ranked = returns.withColumn("_r", F.row_number().over(by_symbol(descending=True)))
    stats = ranked.groupBy(SYMBOL).agg((F.stddev_samp(value) * math.sqrt(252)).alias("volatility"), (F.exp(F.sum(F.when(F.col("_r") <= 30, F.ln(F.greatest(1 + F.col(value), F.lit(1e-300)))))) - 1).alias("return_30"))
    regime = F.when(F.col("volatility") > high_vol, "high_volatility").when(F.col("return_30") > move, "bull").when(F.col("return_30") < -move, "bear").otherwise("sideways")
    return stats.withColumn("regime", regime)


def half_trend(df: DataFrame, value: str) -> DataFrame:
    """Mean of the second half of each series minus that of the first (the middle row counts as second)."""
    ranked = df.withColumns({"_r": F.row_number().over(by_symbol()), "_n": F.count("*").over(Window.partitionBy(SYMBOL))})
    first = F.col("_r") <= F.floor(F.col("_n") / 2)
    return ranked.groupBy(SYMBOL).agg((F.avg(F.when(~first, F.col(value))) - F.avg(F.when(first, F.col(value)))).alias("trend"))


def slope_trend(df: DataFrame, value: str, flat: float = 0.1) -> DataFrame:
    """Mean, median and least-squares slope on the row index, with a label."""
    ranked = df.withColumn("_i", F.row_number().over(by_symbol()) - 1)
    out = ranked.groupBy(SYMBOL).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.regr_slope(F.col(value), F.col("_i")).alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > flat, "increasing").when(F.col("slope") < -flat, "decreasing").otherwise("stable"))


def zscore_anomalies(df: DataFrame, value: str, window: int = 100, least: int = 10, limit: float = 3.0) -> DataFrame:
    """``z`` of each value against up to ``window`` earlier ones, and whether it is beyond ``limit``."""
    before = by_symbol().rowsBetween(-window, -1)
    n, mean, std = F.count(value).over(before), F.avg(value).over(before), F.stddev_samp(value).over(before)
    z = F.when((n >= least) & (std > 0), (F.col(value) - mean) / std)
    return df.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def plausibility(prices: DataFrame) -> DataFrame:
    """Flags of implausible OHLCV rows: daily change, opening gap, range, volume, 3-sigma change."""
    change = ratio_change(F.col("close"), F.lag("close").over(by_symbol()))
    gap = ratio_change(F.col("open"), F.lag("close").over(by_symbol()))
    rows = prices.withColumns({"_change": change, "_gap": gap})
    every = Window.partitionBy(SYMBOL)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        SYMBOL, DATE, flag(F.abs("_change") > 0.5).alias("big_change"), flag(F.abs("_gap") > 0.2).alias("big_gap"), flag((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("bad_range"),
        flag(F.col("volume") > 10 * F.avg("volume").over(every)).alias("big_volume"), flag(F.abs(F.col("_change") - F.avg("_change").over(every)) > 3 * F.stddev_samp("_change").over(every)).alias("outlier"),
    )


def sliding_windows(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """The ``n`` values before each row as an array, for rows that have as many."""
    frame = by_symbol().rowsBetween(-n, -1)
    return df.withColumn("window", F.collect_list(value).over(frame)).where(F.size("window") == n)


def business_days(df: DataFrame) -> DataFrame:
    """Every weekday between a symbol's first and last date, values filled forward."""
    span = df.groupBy(SYMBOL).agg(F.explode(F.sequence(F.min(DATE), F.max(DATE))).alias(DATE)).where(F.weekday(DATE) < 5)
    return span.join(df, [SYMBOL, DATE], "left")


def asof_join(left: DataFrame, right: DataFrame, value: str, default=None) -> DataFrame:
    """The last right value on or before each left row's date, by symbol.

    Both sides are merged in one ordered window; no range join is needed.
    """
    marked = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    facts = right.select(SYMBOL, DATE, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = Window.partitionBy(SYMBOL).orderBy(DATE, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.unionByName(facts, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_side", "_v")
    return filled if default is None else filled.fillna(default, [value])


def backtest_truth(df: DataFrame, value: str = "close", ahead: int = 3) -> DataFrame:
    """Rolling-origin truth: the next ``ahead`` values of each row, for rows that have all."""
    nexts = [F.lead(value, k).over(by_symbol()).alias(f"truth_{k}") for k in range(1, ahead + 1)]
    return df.select("*", *nexts).where(F.col(f"truth_{ahead}").isNotNull())


def last_days(df: DataFrame, days: int, least: int = 10) -> DataFrame:
    """Rows of the trailing days; if fewer than ``least`` remain but as many exist, the last ``least`` rows."""
    every = Window.partitionBy(SYMBOL)
    rows = df.withColumns({"_in": F.col(DATE) >= F.date_sub(F.max(DATE).over(every), days), "_r": F.row_number().over(by_symbol(descending=True)), "_n": F.count("*").over(every)})
    rows = rows.withColumn("_k", F.count_if(F.col("_in")).over(every))
    few = (F.col("_k") < least) & (F.col("_n") >= least)
    return rows.where(F.when(few, F.col("_r") <= least).otherwise(F.col("_in"))).drop("_in", "_r", "_n", "_k")
