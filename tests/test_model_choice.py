"""Differencing, moving-average terms and model summaries against plain restatements."""

import math

import numpy as np
import pytest
from test_forecast import KEYS, simulate, table, training

from lanescope.operators import arma, autoregression as ar, forecast, stationarity, summary
from lanescope.schema import NORMAL_90


def statistic(z):
    """By autocovariances, lag by lag."""
    n = len(z)
    e = z - z.mean()
    lags = int(3 * np.sqrt(n) / 13)
    spread = (e * e).sum() + 2 * sum(
        (1 - lag / (lags + 1)) * (e[lag:] * e[:-lag]).sum() for lag in range(1, lags + 1)
    )
    return (np.cumsum(e) ** 2).sum() / (n * spread), lags


def mixed(theta, phi, n, seed, constant=1.0):
    noise, y = np.random.default_rng(seed).normal(size=n + 200), np.zeros(n + 200)
    for t in range(2, n + 200):
        y[t] = constant + noise[t] + sum(f * y[t - k] for k, f in enumerate(phi, 1)) + sum(
            h * noise[t - k] for k, h in enumerate(theta, 1))
    return y[200:]


def split_of(spark, **series):
    return forecast.split_series(table(spark, **series), KEYS).cache()


def test_statistics_equal_plain_autocovariances(spark):
    series = {
        "a": simulate([0.5], 200, 1), "b": simulate([0.3], 150, 2, d=1), "c": simulate([], 61, 3, d=2),
        "e": np.arange(90.0) + simulate([], 90, 4), "f": 1e6 + simulate([0.2], 700, 5),
    }
    rows = {(r.k, r.d): r for r in stationarity.level_statistics(split_of(spark, **series), KEYS).collect()}
    assert len(rows) == 15
    for k, y in series.items():
        for d in range(3):
            z = np.diff(training(y), n=d)
            expected, lags = statistic(z)
            assert (rows[k, d].n, rows[k, d].lags) == (len(z), lags)
            assert rows[k, d].statistic == pytest.approx(expected, rel=1e-6)


def test_planted_trends_choose_d(spark):
    noise = np.random.default_rng(7).normal(size=800)
    series = {
        "level": noise, "walk": np.cumsum(noise), "twice": np.cumsum(np.cumsum(noise)),
        "line": np.arange(800.0) + noise, "constant": np.full(50, 3.0), "two": [1.0, 2.0, 4.0],
        "ramp": np.arange(60.0), "empty": [1.0],
    }
    rows = {r.k: r for r in stationarity.choose_d(split_of(spark, **series), KEYS).collect()}
    assert {k: r.d for k, r in rows.items() if k in ("level", "walk", "twice", "line", "constant", "ramp")} == {
        "level": 0, "walk": 1, "twice": 2, "line": 1, "constant": 0, "ramp": 1}
    assert rows["constant"].level_0 is None and rows["ramp"].level_1 is None
    assert "empty" not in rows  # it has no training hour


def test_chosen_d_gives_the_models_of_that_d(spark):
    series = {"a": simulate([0.5, 0.3], 300, 3), "b": simulate([0.4], 400, 4, d=1), "c": [5.0] * 30}
    split = split_of(spark, **series)
    chosen = stationarity.choose_d(split, KEYS)
    assert {r.k: r.d for r in chosen.collect()} == {"a": 0, "b": 1, "c": 0}
    model = ar.fit_ar(split, KEYS, d=chosen)
    fixed = [{r.k: r for r in ar.fit_ar(split, KEYS, d=d).collect()} for d in (0, 1)]
    rows = {r.k: r for r in model.collect()}
    for k, d in (("a", 0), ("b", 1), ("c", 0)):
        same = fixed[d][k]
        assert (rows[k].p, rows[k].d, rows[k].n, rows[k].phi) == (same.p, d, same.n, same.phi)
    ours = {(r.k, r.datetime): r.forecast for r in ar.forecast_ar(split, model, KEYS, 5).collect()}
    for d, k in ((0, "a"), (1, "b")):
        for r in ar.forecast_ar(split, ar.fit_ar(split, KEYS, d=d), KEYS, 5).where(f"k = '{k}'").collect():
            if r.forecast is not None:
                assert ours[r.k, r.datetime] == pytest.approx(r.forecast)


def squares(z, constant, phi, theta, start):
    """Shocks one by one."""
    shocks = np.zeros(len(z))
    for t in range(start, len(z)):
        shocks[t] = z[t] - constant - sum(f * z[t - k] for k, f in enumerate(phi, 1)) - sum(
            h * shocks[t - k] for k, h in enumerate(theta, 1) if t - k >= start)
    return shocks


@pytest.mark.parametrize("theta, phi", [([0.6], []), ([-0.5], [0.7]), ([0.5, 0.3], []), ([], [0.5, 0.3])])
def test_planted_moving_averages_are_recovered(spark, theta, phi):
    model = arma.fit_arma(split_of(spark, a=mixed(theta, phi, 9000, 21)), KEYS).first()
    wanted = np.array([*phi, *([0] * (2 - len(phi))), *theta, *([0] * (2 - len(theta)))])
    found = np.array([*model.phi, *([0] * (2 - model.p)), *model.theta, *([0] * (2 - model.q))])
    if (model.p, model.q) == (len(phi), len(theta)):
        assert found == pytest.approx(wanted, abs=0.05)
    else:  # AIC may take a further term; then the weights of past shocks agree
        def weights(c):
            psi = [1.0]
            for k in range(1, 8):
                psi.append((c[1 + k] if k <= 2 else 0) + sum(
                    c[i] * psi[k - 1 - i] for i in range(2) if k - 1 - i >= 0))
            return psi
        assert weights(found) == pytest.approx(weights(wanted), abs=0.06)
    assert model.sigma == pytest.approx(1.0, abs=0.03)


def test_estimates_are_least_squares_and_aic_chooses(spark):
    series = {"a": mixed([0.6], [], 400, 5), "b": 50 + mixed([-0.4], [0.6], 333, 6), "c": mixed([], [0.5], 120, 8)}
    rows = {r.k: r for r in arma.fit_arma(split_of(spark, **series), KEYS).collect()}
    for k, y in series.items():
        z, m = training(y), rows[k]
        shocks = squares(z, m.intercept, m.phi, m.theta, 2)
        sse, n = (shocks**2).sum(), len(z) - 2
        assert m.n == n and m.aic == pytest.approx(n * np.log(sse / n) + 2 * (m.p + m.q + 2), rel=1e-9)
        assert m.sigma == pytest.approx(np.sqrt(sse / (n - m.p - m.q - 1)), rel=1e-9)
        assert m.shocks == pytest.approx(shocks[::-1][: m.q].tolist(), abs=1e-8)
        coefficients = [m.intercept, *m.phi, *m.theta]
        for i in range(len(coefficients)):  # no coefficient can be moved for the better
            for move in (-1e-3, 1e-3):
                moved = list(coefficients)
                moved[i] += move
                other = squares(z, moved[0], moved[1 : 1 + m.p], moved[1 + m.p :], 2)
                assert (other**2).sum() >= sse - 1e-9 * sse
    # Without moving-average terms these are the autoregressions.
    split = split_of(spark, **series)
    plain = {r.k: r for r in ar.fit_ar(split, KEYS, max_p=3).collect()}
    for r in arma.fit_arma(split, KEYS, max_p=3, max_q=0).collect():
        assert (r.p, r.theta) == (plain[r.k].p, [])
        assert (r.phi, r.aic) == (pytest.approx(plain[r.k].phi, abs=1e-6), pytest.approx(plain[r.k].aic))


@pytest.mark.parametrize("d", [0, 1])
def test_forecasts_and_intervals_use_the_shocks(spark, d):
    y = mixed([0.7, 0.2], [0.4], 300, 9)
    y = np.cumsum(y) if d else y
    split = split_of(spark, a=y)
    model = arma.fit_arma(split, KEYS, d=d)
    m = model.first()
    assert m.q > 0
    train = training(y)
    z = np.diff(train, n=d)
    shocks = list(squares(z, m.intercept, m.phi, m.theta, 2))
    history, level, path = list(z), train[-1], []
    for _ in range(len(y) - len(train) + 6):
        value = m.intercept + sum(f * history[-k] for k, f in enumerate(m.phi, 1)) + sum(
            h * shocks[-k] for k, h in enumerate(m.theta, 1))
        history.append(value)
        shocks.append(0.0)
        level = level + value if d else value
        path.append(level)
    psi = [1.0]  # weights of past shocks, then summed once for d = 1
    for k in range(1, len(path)):
        psi.append((m.theta[k - 1] if k <= m.q else 0) + sum(
            f * psi[k - i] for i, f in enumerate(m.phi, 1) if k >= i))
    psi = np.cumsum(psi) if d else np.array(psi)
    half = NORMAL_90 * m.sigma * np.sqrt(np.cumsum(psi**2))
    back = ar.backtest_ar(split, model, KEYS).where("test_data IS NOT NULL").orderBy("datetime").toPandas()
    ahead = ar.forecast_ar(split, model, KEYS, 6).where("observed IS NULL").orderBy("datetime").toPandas()
    ours = np.concatenate([back.prediction, ahead.forecast])
    np.testing.assert_allclose(ours, path, rtol=1e-8)
    np.testing.assert_allclose(np.concatenate([back.upper, ahead.upper]) - ours, half, rtol=1e-6)


@pytest.mark.parametrize("values", [[5.0] * 40, [1.0, 2.0, 3.0], [float(2**i) for i in range(14)]])
def test_series_without_a_mixed_model(spark, values):
    split = split_of(spark, a=values, b=mixed([0.6], [], 200, 3))
    model = arma.fit_arma(split, KEYS)
    rows = {r.k: r for r in model.collect()}
    assert rows["b"].q is not None and rows["b"].phi is not None
    if rows["a"].phi is None:
        last = float(training(np.array(values))[-1])
        got = ar.forecast_ar(split, model, KEYS, 4).where("k = 'a' AND observed IS NULL").collect()
        assert [(r.forecast, r.lower) for r in got] == [(last, None)] * 4


def test_summary_equals_plain_regression(spark):
    series = {"a": simulate([0.5, 0.2], 260, 3), "b": 30 + simulate([0.4], 300, 4, d=1), "c": [2.0] * 40}
    split = split_of(spark, **series)
    model = ar.fit_ar(split, KEYS, d=stationarity.choose_d(split, KEYS))
    fitted = {r.k: r for r in model.collect()}
    rows = {r.k: r for r in summary.model_summary(split, model, KEYS).collect()}
    assert rows["c"].p is None and rows["c"].intercept_se is None and rows["c"].ljung_box is None
    for k in ("a", "b"):
        m, r = fitted[k], rows[k]
        z = np.diff(training(np.array(series[k])), n=m.d)
        x = np.array([[1.0, *[z[t - i] for i in range(1, m.p + 1)]] for t in range(5, len(z))])
        target = z[5:]
        coef = np.linalg.lstsq(x, target, rcond=None)[0]
        e = target - x @ coef
        n = len(e)
        error = np.sqrt(np.diag((e @ e) / (n - m.p - 1) * np.linalg.inv(x.T @ x)))
        assert (r.intercept_se, r.intercept_z) == pytest.approx((error[0], coef[0] / error[0]), rel=1e-6)
        for i in range(1, 6):
            own = (r[f"phi_{i}"], r[f"phi_{i}_se"], r[f"phi_{i}_z"])
            assert own == (pytest.approx((coef[i], error[i], coef[i] / error[i]), rel=1e-6)
                           if i <= m.p else (None, None, None))
        var = (e @ e) / n
        likelihood = sum(-0.5 * math.log(2 * math.pi * var) - v * v / (2 * var) for v in e)
        rho = [(e[i:] @ e[:-i]) / (e @ e) for i in range(1, 11)]
        box = n * (n + 2) * sum(v * v / (n - i) for i, v in enumerate(rho, 1))
        skew, kurt = (e**3).mean() / var**1.5, (e**4).mean() / var**2
        jarque = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
        third = round(n / 3)
        expected = (likelihood, n * math.log(var) + (m.p + 2) * math.log(n), box, jarque, skew, kurt,
                    (e[-third:] ** 2).sum() / (e[:third] ** 2).sum(), math.exp(-jarque / 2))
        assert (r.log_likelihood, r.bic, r.ljung_box, r.jarque_bera, r.skewness, r.kurtosis,
                r.heteroskedasticity, r.jarque_bera_p) == pytest.approx(expected, rel=1e-6)
        # The tail of the chi-square distribution with ten degrees, summed from its density.
        grid = np.linspace(box, box + 200, 200_001)
        density = grid**4 * np.exp(-grid / 2) / (2**5 * math.factorial(4))
        assert r.ljung_box_p == pytest.approx(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum(), abs=1e-6)
