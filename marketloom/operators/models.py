"""Forecasts per symbol and a tree ensemble over feature frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.operators import timeseries as ts
from marketloom.staging import shared_path, staged


def autoregression(values: np.ndarray, order: int, steps: int) -> np.ndarray:
    """Forecasts of an AR model of so many lags, fitted by least squares on differences."""
    d = np.diff(values)
    if len(d) <= 2 * order:
        return np.full(steps, values[-1])
    x = np.column_stack([np.ones(len(d) - order), *(d[order - k - 1 : len(d) - k - 1] for k in range(order))])
    coef, *_ = np.linalg.lstsq(x, d[order:], rcond=None)
    past, out, level = list(d[-order:][::-1]), [], values[-1]
    for _ in range(steps):
        move = float(coef[0] + np.dot(coef[1:], past))
        past = [move, *past[:-1]]
        level += move
        out.append(level)
    return np.array(out)


def forecast(prices: DataFrame, order: int = 5, steps: int = 3) -> DataFrame:
    """``symbol, step, forecast``: every series is fitted by its own task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("date")["close"].dropna().to_numpy(float)
        out = autoregression(values, order, steps) if len(values) else np.full(steps, np.nan)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "step": np.arange(1, steps + 1, dtype="int32"), "forecast": out})

    return prices.select("symbol", "date", "close").groupBy("symbol").applyInPandas(one, "symbol string, step int, forecast double")


# The (p, d, q) that are tried, in that order, and the fewest prices of a forecast.
ORDERS = [(1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (0, 1, 1), (1, 1, 0), (0, 1, 0)]
MIN_PRICES = 30
NORMAL_95 = 1.959963984540054


def lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns of ``x`` one to ``lags`` steps back, from row ``start`` on."""
    return np.column_stack([x[start - k : len(x) - k] for k in range(1, lags + 1)]) if lags else np.zeros((len(x) - start, 0))


def stable(coefficients: np.ndarray) -> bool:
    """Whether the recursion ``x = sum of c[k] x[k back]`` dies out."""
    n = len(coefficients)
    if not n:
        return True
    step = np.eye(n, k=-1)
    step[0] = coefficients
    return bool(np.abs(np.linalg.eigvals(step)).max() < 1)


@dataclass
class Arima:
    """A fitted (p, 1, q): coefficients, variance of the innovations, AIC, and the last values that forecasts need."""

    order: tuple
    ar: np.ndarray
    ma: np.ndarray
    variance: float
    aic: float
    moves: np.ndarray
    shocks: np.ndarray
    level: float

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the next steps, and their standard errors."""
        moves, shocks, out = list(self.moves), list(self.shocks), []
        weights, total, spread = [1.0], 1.0, []
        for h in range(steps):
            move = sum(c * moves[-k] for k, c in enumerate(self.ar, 1)) + sum(c * shocks[-k] for k, c in enumerate(self.ma, 1))
            moves.append(float(move))
            shocks.append(0.0)
            out.append((out[-1] if out else self.level) + moves[-1])
            spread.append((spread[-1] if spread else 0.0) + total**2)
            weights.append(sum(c * weights[-k] for k, c in enumerate(self.ar, 1) if k <= len(weights)) + (self.ma[h] if h < len(self.ma) else 0.0))
            total += weights[-1]
        return np.array(out), np.sqrt(self.variance * np.array(spread))


def fit_arima(values: np.ndarray, order: tuple[int, int, int]) -> Arima | None:
    """Two regressions (Hannan and Rissanen): a long autoregression tells the innovations, then moves are explained by moves and innovations.

    All orders are fitted on the same rows, so that their AIC can be compared.
    None if the fit is not stable, or rows are too few.
    """
    moves, (p, _, q) = np.diff(values), order
    long = max(4, min(10, len(moves) // 6))
    start = long + 2
    if len(moves) - start < 2 * (p + q) + 3:
        return None
    first = np.linalg.lstsq(lagged(moves, long, long), moves[long:], rcond=None)[0]
    shocks = np.concatenate([np.zeros(long), moves[long:] - lagged(moves, long, long) @ first])
    x, y = np.column_stack([lagged(moves, p, start), lagged(shocks, q, start)]), moves[start:]
    found = np.linalg.lstsq(x, y, rcond=None)[0] if p + q else np.zeros(0)
    rest = y - x @ found
    variance = float(rest @ rest) / len(y)
    if not (stable(found[:p]) and stable(-found[p:])):
        return None
    aic = len(y) * np.log(max(variance, 1e-300)) + 2 * (p + q + 1)
    return Arima(order, found[:p], found[p:], variance, float(aic), moves[-2:], np.concatenate([np.zeros(2), rest])[-2:], float(values[-1]))


def choose_arima(values: np.ndarray) -> Arima | None:
    """The order of least AIC, the first of equals."""
    fits = [f for o in ORDERS if (f := fit_arima(values, o))]
    return min(fits, key=lambda f: f.aic) if fits else None


def arima_forecasts(prices: DataFrame, steps: int = 7) -> DataFrame:
    """``symbol, step, forecast, low, high, model, aic, mae, rmse, success`` for each symbol and step.

    The order is chosen on all prices; ``mae`` and ``rmse`` are those of a fit
    of that order on all but the last fifth, which it forecasts. The first row of a
    repeated date counts. Fewer than ``MIN_PRICES`` prices, or none that fits,
    give one row without a forecast. Each series is fitted by its own task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.dropna(subset=["close"]).sort_values(["date", "close"]).drop_duplicates("date")["close"].to_numpy(float)
        symbol, fitted = pdf["symbol"].iloc[0], choose_arima(values) if len(values) >= MIN_PRICES else None
        if fitted is None:
            return pd.DataFrame([(symbol, None, None, None, None, None, None, None, None, False)], columns=names).astype({"success": bool})
        held = max(1, len(values) // 5)
        train = fit_arima(values[:-held], fitted.order)
        miss = train.forecast(held)[0] - values[-held:] if train else np.array([np.nan])
        level, error = fitted.forecast(steps)
        out = pd.DataFrame({"symbol": symbol, "step": np.arange(1, steps + 1), "forecast": level, "low": level - NORMAL_95 * error, "high": level + NORMAL_95 * error})
        return out.assign(model=",".join(map(str, fitted.order)), aic=fitted.aic, mae=float(np.abs(miss).mean()), rmse=float(np.sqrt((miss**2).mean())), success=True)

    schema = "symbol string, step int, forecast double, low double, high double, model string, aic double, mae double, rmse double, success boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return prices.select("symbol", "date", "close").groupBy("symbol").applyInPandas(one, schema)


def forecast_metrics(forecasts: DataFrame) -> DataFrame:
    """``symbol, success, model, mae, rmse, final, change`` of each symbol: its errors, last forecast and the change to it from the first."""
    last = F.max_by("forecast", "step")
    return forecasts.groupBy("symbol").agg(F.bool_or("success").alias("success"), F.first("model").alias("model"), F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), last.alias("final"), (last / F.min_by("forecast", "step") - 1).alias("change"))


def feature_frame(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Returns, volatility and market move of each row, and the next row's return as the label."""
    rows = prices.select("symbol", "date", "close", ts.simple_return().alias("ret"))
    rows = rows.select("*", ts.rolling_volatility("ret", 5).alias("volatility"), F.lead("ret").over(ts.by_symbol()).alias("label"))
    return rows.join(market, "date", "left").fillna(0.0, ["ret", "market_ret"])


def tree_forecast(features: DataFrame, columns: list[str], trees: int = 20, depth: int = 5) -> DataFrame:
    """Mean of a random forest and boosted trees for the last row of each symbol."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(features)
    known = rows.where("label is not null")
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42, predictionCol="forest").fit(known)
    boosted = GBTRegressor(maxIter=10, maxDepth=depth, seed=42, predictionCol="boosted").fit(known)
    last = rows.where("label is null")
    return boosted.transform(forest.transform(last)).select("symbol", "date", ((F.col("forest") + F.col("boosted")) / 2).alias("forecast"))


def leaf_values(forest, spark) -> DataFrame:
    """``tree, leaf, value`` of a fitted forest, leaves from left to right; trees times leaves of a tree bound its size."""
    path = shared_path(spark, "forest")
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    # nodes are numbered in preorder, so leaves by number go from left to right
    leaf = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    return nodes.where("leftChild < 0").select("tree", leaf.alias("leaf"), F.col("prediction").alias("value"))


def tree_spread(forest, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, spread``: how far the forest's own trees lie apart (deviation, divisor n) at each of ``rows`` (keys, features)."""
    from pyspark.ml.functions import vector_to_array

    model = forest.copy().setLeafCol("_leaf")
    each = model.transform(rows).select(*keys, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    return each.join(leaf_values(forest, rows.sparkSession), ["tree", "leaf"]).groupBy(*keys).agg(F.stddev_pop("value").alias("spread"))


# The move at once and the sentiment that together raise a flag.
FLAG_MOVE, FLAG_SENTIMENT = -0.05, -0.3


def tree_outlook(features: DataFrame, columns: list[str], trees: int = 200, depth: int = 10, boosts: int = 100, boost_depth: int = 5, steps: int = 3, from_last: bool = False) -> DataFrame:
    """``symbol, step, date, forecast, confidence, red_flag``: prices of the next steps from the returns that two ensembles expect.

    ``features``: ``symbol, date, close, ret, volatility, sentiment`` and
    ``columns``; rows without one of them are left out, symbols with fewer than
    two have no forecast. A forest and boosted trees are fitted on all symbols'
    returns. The level from which a symbol's forecasts start is its first price
    moved by all returns that the ensembles find for its rows, or with
    ``from_last`` its last price (the product of long and wild series leaves
    the range of a double); each step moves it by what they expect at its last
    row. Confidence is 1 / (1 + spread *
    volatility), of the spread of the forest's trees at that row. A flag goes up
    where a great fall meets a bad sentiment. Dates of a symbol must differ.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    needed = list(dict.fromkeys(["symbol", "date", "close", "ret", "volatility", "sentiment", *columns]))
    rows = features.select(*needed).dropna()
    enough = rows.groupBy("symbol").agg(F.count("*").alias("_n")).where("_n > 1").select("symbol")
    rows = staged(rows.join(enough, "symbol", "left_semi"), "features")
    schema = f"symbol {rows.schema['symbol'].dataType.simpleString()}, step int, date {rows.schema['date'].dataType.simpleString()}, forecast double, confidence double, red_flag boolean"
    if rows.isEmpty():
        return features.sparkSession.createDataFrame([], schema)
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    forest = RandomForestRegressor(labelCol="ret", numTrees=trees, maxDepth=depth, seed=42, predictionCol="forest").fit(ready)
    boosted = GBTRegressor(labelCol="ret", maxIter=boosts, maxDepth=boost_depth, seed=42, predictionCol="boosted").fit(ready)
    fitted = boosted.transform(forest.transform(ready)).withColumn("move", 1 + (F.col("forest") + F.col("boosted")) / 2)
    last = F.max_by(F.struct("date", "move", "volatility", "sentiment", "features"), "date").alias("last")
    # the first row's own return leads to no price: its price is where the level starts
    moves = F.product(F.when(F.col("date") == F.col("_first"), 1.0).otherwise(F.col("move")))
    first = rows.groupBy("symbol").agg(F.min("date").alias("_first"))
    ends = staged(fitted.join(first, "symbol").groupBy("symbol").agg((F.max_by("close", "date") if from_last else F.min_by("close", "date") * moves).alias("level"), last).select("symbol", "level", "last.*"), "ends")
    spread = tree_spread(forest, ends.select("symbol", "features"), ["symbol"])
    out = ends.drop("features").join(spread, "symbol").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    flag = (F.col("move") - 1 <= FLAG_MOVE) & (F.col("sentiment") <= FLAG_SENTIMENT)
    return out.select("symbol", "step", F.date_add("date", F.col("step")).cast(rows.schema["date"].dataType).alias("date"), F.round(F.col("level") * F.pow("move", F.col("step")), 2).alias("forecast"), (1 / (1 + F.col("spread") * (F.col("volatility") + 1e-6))).alias("confidence"), flag.alias("red_flag"))


def scored(df: DataFrame, text: str, scorer, out: str = "score") -> DataFrame:
    """An injected scorer (list of texts -> list of numbers) applied batch by batch."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(scorer([x or "" for x in column]))

    return df.withColumn(out, run(text))
