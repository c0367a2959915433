"""Split, models, predictions and scores against numpy written out plainly."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import at
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lanescope.operators import autoregression as ar
from lanescope.operators import forecast
from lanescope.schema import NORMAL_90

KEYS = ["k"]
SERIES = "datetime TIMESTAMP_NTZ, k STRING, LOS DOUBLE"


def table(spark, **series):
    rows = [
        (at(0) + timedelta(hours=i), k, None if y is None else float(y))
        for k, values in series.items() for i, y in enumerate(values)
    ]
    return spark.createDataFrame(rows, SERIES).repartition(3)


def simulate(phi, n, seed, constant=2.0, d=0):
    noise, y = np.random.default_rng(seed).normal(size=n + 100), np.zeros(n + 100)
    for t in range(len(phi), n + 100):
        y[t] = constant + np.dot(phi, y[t - len(phi) : t][::-1]) + noise[t]
    y = y[100:]
    for _ in range(d):
        y = np.cumsum(y)
    return y


def training(y):
    return y[: len(y) - int(np.ceil(0.3 * len(y)))]


def design(z, p, max_p):
    rows = range(max_p, len(z))
    x = np.array([[1.0, *[z[t - k] for k in range(1, p + 1)]] for t in rows])
    return x, z[max_p:]


def brute_fit(y, max_p, d=0):
    """Least squares per order on a common sample, least AIC among the stationary ones."""
    z = np.diff(training(y), n=d)
    best = None
    for p in range(max_p + 1):
        x, target = design(z, p, max_p)
        coef, *_ = np.linalg.lstsq(x, target, rcond=None)
        sse = ((target - x @ coef) ** 2).sum()
        n = len(target)
        roots = np.roots(np.concatenate([[1], -coef[1:]])) if p else np.array([0.0])
        if p and np.abs(roots).max() >= 1:
            continue
        aic = n * np.log(sse / n) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p, coef, np.sqrt(sse / (n - p - 1)))
    return best


def brute_path(y, coef, sigma, d, steps):
    """Forecast the differences one by one and integrate; interval from simulated unit shocks."""
    train = training(y)

    def run(shock):
        # With a shock the noise of the first step is 1 and history and constant are 0.
        history = list(np.zeros(len(train)) if shock else train)
        out = []
        for step in range(steps):
            levels = [np.array(history)]
            for _ in range(d):
                levels.append(np.diff(levels[-1]))
            z = levels[d]
            value = (0 if shock else coef[0]) + sum(
                coef[k] * (z[-k] if len(z) >= k else 0) for k in range(1, len(coef))
            )
            value += 1 if shock and step == 0 else 0
            for level in reversed(levels[:d]):
                value += level[-1]
            history.append(value)
            out.append(value)
        return np.array(out)

    half = NORMAL_90 * sigma * np.sqrt(np.cumsum(run(True) ** 2))
    return run(False), half


@pytest.mark.parametrize("n, train", [(1, 0), (2, 1), (10, 7), (71, 49), (100, 70)])
def test_split(spark, n, train):
    split = forecast.split_series(table(spark, a=range(n)), KEYS).orderBy("datetime").collect()
    assert [r.split for r in split] == ["train"] * train + ["test"] * (n - train)
    assert [r.position for r in split] == list(range(1, n + 1))
    assert [r.y for r in split] == list(range(n))
    assert {r.hours for r in split} == {n}


def test_split_trims_leading_nulls(spark):
    split = forecast.split_series(table(spark, a=[None, None, *range(10)], b=[None] * 12), KEYS)
    rows = split.orderBy("datetime").collect()
    assert [r.y for r in rows] == list(range(10)) and rows[0].datetime == at(2)


def test_ar1_model_equals_the_regression_line(spark):
    y = simulate([0.6], 120, 1)
    split = forecast.split_series(table(spark, a=y), KEYS)
    model = forecast.fit_ar1(split, KEYS).first()
    train = training(y)
    slope, intercept = np.polyfit(train[:-1], train[1:], 1)
    residual = train[1:] - intercept - slope * train[:-1]
    assert (model.phi, model.intercept) == pytest.approx((slope, intercept))
    assert model.sigma == pytest.approx(np.sqrt((residual ** 2).sum() / (len(residual) - 2)))
    assert (model.n_train, model.n, model.last_y) == (84, 83, train[-1])


def test_ar1_and_the_general_path_agree_for_one_lag(spark):
    data = table(spark, a=simulate([0.6], 120, 1), b=simulate([-0.4], 90, 2))
    split = forecast.split_series(data, KEYS).cache()
    line, general = forecast.fit_ar1(split, KEYS), ar.fit_ar(split, KEYS, max_p=1)
    lines = {r.k: r for r in line.collect()}
    for row in general.collect():
        one = lines[row.k]
        assert row.p == 1
        assert (row.phi[0], row.intercept, row.sigma, row.aic) == pytest.approx(
            (one.phi, one.intercept, one.sigma, one.aic)
        )
    for closed, recursive in (
        (forecast.backtest_ar1(split, line, KEYS), ar.backtest_ar(split, general, KEYS)),
        (forecast.forecast_ar1(split, line, KEYS, 48), ar.forecast_ar(split, general, KEYS, 48)),
    ):
        assert closed.columns == recursive.columns
        sides = [x.toPandas().sort_values(["k", "datetime"]).reset_index(drop=True)
                 for x in (closed, recursive)]
        pd.testing.assert_frame_equal(*sides, rtol=1e-8, check_dtype=False)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_general_model_and_path_equal_brute_force(spark, d):
    series = {
        "a": simulate([0.5, 0.3], 200, 3, d=d), "b": simulate([0.2, 0.0, 0.5], 150, 4, d=d),
        "c": simulate([], 80, 5, d=d), "e": 1000 + simulate([0.9], 61, 6, d=d),
    }
    split = forecast.split_series(table(spark, **series), KEYS).cache()
    model = ar.fit_ar(split, KEYS, d=d)
    rows = {r.k: r for r in model.collect()}
    paths = ar.forecast_ar(split, model, KEYS, 30).toPandas()
    tests = ar.backtest_ar(split, model, KEYS).toPandas()
    for k, y in series.items():
        aic, p, coef, sigma = brute_fit(y, 5, d)
        assert rows[k].p == p and rows[k].d == d
        assert rows[k].phi == pytest.approx(coef[1:].tolist(), rel=1e-6, abs=1e-8)
        assert (rows[k].intercept, rows[k].sigma, rows[k].aic) == pytest.approx(
            (coef[0], sigma, aic), rel=1e-5, abs=1e-6
        )
        n_test = len(y) - len(training(y))
        path, half = brute_path(y, coef, sigma, d, n_test + 30)
        own = paths[paths.k == k].sort_values("datetime")
        ahead = own[own.observed.isna()]
        assert len(own) == len(y) + 30 and len(ahead) == 30
        assert ahead.datetime.iloc[0] == pd.Timestamp(at(0)) + pd.Timedelta(hours=len(y))
        np.testing.assert_allclose(ahead.forecast, path[n_test:], rtol=1e-5)
        np.testing.assert_allclose(ahead.upper - ahead.lower, 2 * half[n_test:], rtol=1e-5)
        back = tests[tests.k == k].sort_values("datetime")
        held = back[back.test_data.notna()]
        np.testing.assert_allclose(held.prediction, path[:n_test], rtol=1e-5)
        assert back[back.training_data.notna()].prediction.isna().all()
        np.testing.assert_allclose(pd.concat([
            back.training_data.dropna(), back.test_data.dropna()
        ]), y)


def test_planted_coefficients_are_recovered(spark):
    y = simulate([0.5, 0.3], 20_000, 11)
    model = ar.fit_ar(forecast.split_series(table(spark, a=y), KEYS), KEYS).first()
    assert model.p >= 2
    assert model.phi[:2] == pytest.approx([0.5, 0.3], abs=0.03)
    assert model.sigma == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("values", [
    [5.0] * 40, [1.0, 2.0], [3.0], [float(2 ** i) for i in range(30)],
], ids=["constant", "two rows", "one row", "explosive"])
def test_unusable_models_hold_the_last_training_value(spark, values):
    split = forecast.split_series(table(spark, a=values), KEYS).cache()
    if len(training(np.array(values))) == 0:
        return
    last = float(training(np.array(values))[-1])
    line = forecast.fit_ar1(split, KEYS)
    first = line.first()
    assert (first.phi, first.intercept, first.sigma, first.aic) == (None, None, None, None)
    rows = forecast.forecast_ar1(split, line, KEYS, 24).where("observed IS NULL").collect()
    assert [r.forecast for r in rows] == [last] * 24
    assert {(r.lower, r.upper) for r in rows} == {(None, None)}
    if len(values) == 30:
        return  # an explosive series still has the model of order 0
    general = ar.fit_ar(split, KEYS)
    assert general.first().phi is None and general.first().p is None
    rows = ar.forecast_ar(split, general, KEYS, 24).where("observed IS NULL").collect()
    assert [r.forecast for r in rows] == [last] * 24
    assert {(r.lower, r.upper) for r in rows} == {(None, None)}


def test_explosive_series_falls_back_to_the_mean(spark):
    split = forecast.split_series(table(spark, a=[1.5 ** i for i in range(60)]), KEYS)
    assert ar.fit_ar(split, KEYS).first().p == 0


def test_scores(spark):
    rows = spark.createDataFrame(
        [("a", 2.0, 1.0), ("a", 4.0, 6.0), ("a", None, None), ("b", 0.0, 1.0)],
        "k STRING, test_data DOUBLE, prediction DOUBLE",
    )
    scores = {r.k: r for r in forecast.score(rows, KEYS).collect()}
    assert (scores["a"].n_test, scores["a"].mape) == (2, 0.5)
    assert scores["a"].rmse == pytest.approx(np.sqrt(2.5))
    assert scores["b"].mape == pytest.approx(1 / 2.220446049250313e-16)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=40), min_size=1, max_size=4))
def test_any_series_is_forecast_in_full(spark, lists):
    data = table(spark, **{f"s{i}": y for i, y in enumerate(lists)})
    split = forecast.split_series(data, KEYS).cache()
    for rows in (
        ar.forecast_ar(split, ar.fit_ar(split, KEYS), KEYS, 5),
        forecast.forecast_ar1(split, forecast.fit_ar1(split, KEYS), KEYS, 5),
    ):
        rows = rows.collect()
        assert len(rows) == sum(len(y) + 5 for y in lists)
        assert all(np.isfinite(r.forecast) for r in rows if r.observed is None)


def test_long_horizons_are_computed_in_chunks(spark, monkeypatch):
    series = {f"s{i}": simulate([0.5], 40 + 7 * i, i) for i in range(6)}
    split = forecast.split_series(table(spark, **series), KEYS).cache()
    model = ar.fit_ar(split, KEYS).cache()
    whole = ar.forecast_ar(split, model, KEYS, 9).orderBy("k", "datetime").toPandas()
    monkeypatch.setattr(ar, "CHUNK", 25)
    parts = ar.forecast_ar(split, model, KEYS, 9).orderBy("k", "datetime").toPandas()
    pd.testing.assert_frame_equal(whole, parts)


def test_scores_over_observed_hours(spark):
    rows = spark.createDataFrame(
        [("a", 2.0, 3.0), ("a", 0.0, 5.0), ("a", -4.0, -3.0), ("a", None, 9.0), ("b", 0.0, 1.0)],
        "k STRING, test_data DOUBLE, prediction DOUBLE",
    )
    scores = {r.k: r for r in forecast.score_observed(rows, ["k"]).collect()}
    assert (scores["a"].n_test, scores["a"].n_zero, scores["a"].mape) == (3, 1, 0.375)
    assert scores["a"].rmse == pytest.approx(3.0)
    assert (scores["b"].n_test, scores["b"].n_zero, scores["b"].mape) == (1, 1, None)
    assert forecast.score_observed(rows.limit(0), ["k"]).collect() == []
