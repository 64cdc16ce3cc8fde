"""Order choice against a loop of normal equations, and the plan of an experiment against the library's distribution."""

from __future__ import annotations

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregate as ag
from marketloom.operators import models


def series(kind, n=160):
    rng, e, out, move = np.random.default_rng(n), None, [100.0], 0.0
    e = rng.standard_normal(n)
    for t in range(1, n):
        move = {"walk": e[t], "ar": 0.7 * move + e[t], "ma": e[t] + 0.8 * e[t - 1]}[kind]
        out.append(out[-1] + move)
    return np.array(out)


def solve(rows, ys):
    """Least squares by normal equations, with the pseudo-inverse where they are singular."""
    k = len(rows[0]) if rows else 0
    a = [[sum(r[i] * r[j] for r in rows) for j in range(k)] for i in range(k)]
    return list(np.linalg.pinv(np.array(a)) @ np.array([sum(r[i] * y for r, y in zip(rows, ys)) for i in range(k)])) if k else []


def plain_fit(values, p, q):
    w = [b - a for a, b in zip(values, values[1:])]
    m = max(4, min(10, len(w) // 6))
    first = solve([[w[t - k] for k in range(1, m + 1)] for t in range(m, len(w))], w[m:])
    e = [0.0] * m + [w[t] - sum(c * w[t - k] for k, c in enumerate(first, 1)) for t in range(m, len(w))]
    rows = [[*(w[t - k] for k in range(1, p + 1)), *(e[t - k] for k in range(1, q + 1))] for t in range(m + 2, len(w))]
    found = solve(rows, w[m + 2 :]) if p + q else []
    rest = [y - sum(c * x for c, x in zip(found, r)) for r, y in zip(rows, w[m + 2 :])]
    sse = sum(x * x for x in rest)
    for side in (found[:p], [-c for c in found[p:]]):
        if len(side) == 1 and abs(side[0]) >= 1 or len(side) == 2 and max(abs(np.roots([1, -side[0], -side[1]]))) >= 1:
            return None
    return len(rest) * math.log(sse / len(rest)) + 2 * (p + q + 1), found, w, rest


def plain_forecast(values, p, q, steps):
    _, found, w, rest = plain_fit(values, p, q)
    w, e, level, out = list(w), list(rest), values[-1], []
    for _ in range(steps):
        move = sum(found[k - 1] * w[-k] for k in range(1, p + 1)) + sum(found[p + k - 1] * e[-k] for k in range(1, q + 1))
        w.append(move)
        e.append(0.0)
        level += move
        out.append(level)
    return out


@pytest.mark.parametrize("kind", ["walk", "ar", "ma"])
def test_order_and_errors_are_the_loops(spark, kind):
    values = series(kind)
    rows = [(kind, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    got = sorted(models.arima_forecasts(spark.createDataFrame(rows, "symbol string, date date, close double")).collect(), key=lambda r: r.step)
    fits = {o: f for o in models.ORDERS if (f := plain_fit(list(values), o[0], o[2]))}
    best = min(fits, key=lambda o: fits[o][0])
    assert got[0].model == ",".join(map(str, best)) and got[0].aic == pytest.approx(fits[best][0])
    assert [r.forecast for r in got] == pytest.approx(plain_forecast(list(values), best[0], best[2], 7))
    miss = np.array(plain_forecast(list(values[:-32]), best[0], best[2], 32)) - values[-32:]
    assert got[0].mae == pytest.approx(np.abs(miss).mean()) and got[0].rmse == pytest.approx(math.sqrt((miss**2).mean()))
    assert all(r.low < r.forecast < r.high for r in got) and got[6].high - got[6].low > got[0].high - got[0].low


def test_walks_spread_with_the_root_of_time():
    fitted = models.fit_arima(series("walk"), (0, 1, 0))
    level, error = fitted.forecast(9)
    assert level == pytest.approx([fitted.level] * 9) and error == pytest.approx(np.sqrt(fitted.variance * np.arange(1, 10)))


def test_short_series_and_metrics(spark):
    rows = [("few", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i) for i in range(20)] + [("many", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(series("ar"))] + [("none", dt.date(2024, 1, 1), None)]
    out = models.arima_forecasts(spark.createDataFrame(rows, "symbol string, date date, close double"))
    found = {r.symbol: r for r in models.forecast_metrics(out).collect()}
    assert not found["few"].success and not found["none"].success and found["many"].success and found["few"].mae is None
    assert out.where("symbol = 'many'").count() == 7 and out.where("symbol = 'few'").head().forecast is None


def test_normal_distribution(spark):
    ps = [1e-12, 1e-4, 0.02, 0.02425, 0.1, 0.5, 0.8, 0.975, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select("p", ag.normal_quantile(F.col("p")).alias("x")).collect()
    assert all(abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-7 for r in rows if 0 < r.p < 1) and [r.x for r in rows if r.p in (0, 1)] == [None, None]
    xs = [-5.0, -1.5, 0.0, 0.3, 2.0, 6.0]
    assert all(abs(r.y - NormalDist().cdf(r.x)) < 2e-7 for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", ag.normal_cdf(F.col("x")).alias("y")).collect())


def test_plan_of_an_experiment(spark):
    rows = [("control", 1000, 0.10), ("better", 1200, 0.16), ("same", 900, 0.10), ("tiny", 20, 0.0)]
    out = {r.variation: r for r in ag.experiment_plan(spark.createDataFrame(rows, "variation string, users long, rate double"), "variation", "control").collect()}
    n, nd = 2 / (1 / 1000 + 1 / 1200), NormalDist()
    za, zb, h = nd.inv_cdf(0.975), nd.inv_cdf(0.8), 2 * (math.asin(math.sqrt(0.1)) - math.asin(math.sqrt(0.16)))
    mde = (za + zb) * math.sqrt(0.18 / n)
    b = out["better"]
    assert b.winner == "better" and b.significance == "highly_significant" and "strong_lift" in b.advice
    assert b.mde == pytest.approx(mde) and b.effect_size == pytest.approx(h) and b.power == pytest.approx(nd.cdf(h * math.sqrt(n / 2) - za), abs=1e-6)
    middle = 0.1 + mde / 2
    assert b.sample_size == int(2 * (za + zb) ** 2 * middle * (1 - middle) / mde**2)
    assert out["same"].winner is None and out["same"].power == 0 and "low_power" in out["same"].advice and "more_users" in out["tiny"].advice


def test_tree_outlook_is_a_loop_over_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(3)
    rows = []
    for symbol in ("A", "B"):
        close = 100.0
        for i in range(60):
            x = rng.normal(size=2)
            ret = float(0.02 * x[0] - 0.01 * x[1] ** 2 + 0.005 * rng.normal()) if i < 59 or symbol == "A" else -0.2
            close *= 1 + ret
            rows.append((symbol, dt.date(2024, 1, 1) + dt.timedelta(i), close, ret, 0.02, -0.5, float(x[0]), float(x[1]) if ret > -0.2 else 9.0))
    rows += [("C", dt.date(2024, 1, 1), 5.0, 0.1, 0.1, 0.0, 0.0, 0.0), ("A", dt.date(2024, 6, 1), 1.0, None, 0.1, 0.0, 0.0, 0.0)]
    schema = "symbol string, date date, close double, ret double, volatility double, sentiment double, x double, y double"
    features = spark.createDataFrame(rows, schema)
    got = {(r.symbol, r.step): r for r in models.tree_outlook(features, ["x", "y"], trees=8, depth=3, boosts=2).collect()}
    assert sorted(got) == [(s, k) for s in "AB" for k in (1, 2, 3)]
    used = features.where("ret is not null and symbol <> 'C'").repartition(1).sortWithinPartitions("symbol", "date")
    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(used)
    forest = RandomForestRegressor(labelCol="ret", numTrees=8, maxDepth=3, seed=42).fit(ready)
    at = [Vectors.dense([0.1 * i, -0.3 * i]) for i in range(-5, 9)]
    spread = {r.i: r.spread for r in models.tree_spread(forest, spark.createDataFrame(list(enumerate(at)), ["i", "features"]), ["i"]).collect()}
    for i, v in enumerate(at):
        assert abs(spread[i] - np.std([t.predict(v) for t in forest.trees])) < 1e-12
    for s in "AB":
        one = [got[s, k] for k in (1, 2, 3)]
        steps = [b.forecast / a.forecast for a, b in zip(one, one[1:])]
        assert abs(steps[0] - steps[1]) < 1e-3 and [r.date.day for r in one] == [1, 2, 3]
        assert len({(r.confidence, r.red_flag) for r in one}) == 1 and 0 < one[0].confidence < 1
        assert one[0].red_flag == (steps[0] - 1 <= -0.05)
    from_last = {(r.symbol, r.step): r.forecast for r in models.tree_outlook(features, ["x", "y"], trees=8, depth=3, boosts=2, from_last=True).collect()}
    last = {r[0]: r[2] for r in rows if r[0] in "AB" and r[3] is not None}
    for s in "AB":
        assert abs(from_last[s, 2] / from_last[s, 1] - from_last[s, 1] / last[s]) < 1e-3
        assert abs(from_last[s, 2] / from_last[s, 1] - got[s, 2].forecast / got[s, 1].forecast) < 1e-3
    assert models.tree_outlook(features.limit(0), ["x", "y"]).count() == 0
