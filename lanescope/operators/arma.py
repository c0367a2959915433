"""Models with moving-average terms, one per series, their orders chosen by AIC.

``z`` is the ``d`` times differenced series; the model says that z less its autoregression and less
``theta`` times the shocks before is the shock of the hour.  Every pair of orders up to ``max_p`` and
``max_q`` starts from two regressions: a long autoregression gives first shocks, and z on its own
lags and the lags of those shocks gives first coefficients.  Gauss-Newton steps on the sum of squared
shocks follow, each halved until it helps; shocks before the first hour with all lags are zero.

A shock depends on the shock before it, which no window expresses.  So the training hours of a
series, one number an hour, travel to Python as an array; all
series of a batch with all their orders advance through time together.  ``backtest_ar`` and
``forecast_ar`` serve these models too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
    TimestampNTZType,
)

from lanescope.operators.autoregression import EXACT_FIT, _stationary, training_rows
from lanescope.operators.forecast import TIME

MAX_P, MAX_Q = 2, 2
STEPS = 50  # Gauss-Newton steps, halved ones included
SETTLED = 1e-12  # relative gain of a step below which a model is left as it is
MARGIN = 1.01  # inverse roots within this factor of the unit circle count as on it
SERIES = 64  # series that advance together


def _arrays(split: DataFrame, keys: Sequence[str], d: int | DataFrame, reach: int) -> DataFrame:
    """Per series: z as an array in order of time, and what a forecast needs besides."""
    in_order = F.sort_array(F.collect_list(F.struct("position", "y", "z")))
    return (
        training_rows(split, keys, d).groupBy(*keys).agg(
            F.first("d").alias("d"), F.count("*").cast("int").alias("n_train"),
            F.first("hours").alias("hours"), F.max(TIME).alias("last_time"), in_order.alias("rows"),
        )
        .select(
            *keys, "d", "n_train", (F.col("hours") - F.col("n_train")).alias("n_test"), "last_time",
            F.element_at("rows", -1)["y"].alias("last_y"),
            F.transform(F.slice("rows", F.greatest(F.lit(1), F.size("rows") - reach + 1), reach),
                        lambda row: row["y"]).alias("tail"),
            F.filter(F.transform("rows", lambda row: row["z"]), lambda z: z.isNotNull()).alias("z"),
        )
    )


def fit_arma(
    split: DataFrame, keys: Sequence[str], max_p: int = MAX_P, max_q: int = MAX_Q,
    d: int | DataFrame = 0,
) -> DataFrame:
    """One row per series: orders, coefficients, residual deviation, AIC and the last shocks.

    Orders are compared on the same hours, those with ``max_p`` lags; models that are not stationary
    or not invertible, or hardly so, are left out.  ``phi`` is NULL where none can be used: a constant series or one
    with too few rows.  ``d`` is a number or the table of ``stationarity.choose_d``.
    """
    keys = list(keys)
    arrays = _arrays(split, keys, d, max_p + 2)
    schema = StructType([
        *arrays.select(*keys).schema,
        *[StructField(name, IntegerType()) for name in ("p", "q", "d", "n_train", "n_test", "n")],
        StructField("last_y", DoubleType()),
        *[StructField(name, ArrayType(DoubleType())) for name in ("phi", "theta")],
        *[StructField(name, DoubleType()) for name in ("intercept", "sigma", "aic")],
        *[StructField(name, ArrayType(DoubleType())) for name in ("tail", "shocks")],
        StructField("last_time", TimestampNTZType()),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SERIES):
                part = batch.iloc[at : at + SERIES].reset_index(drop=True)
                yield _solve(part, max_p, max_q)[schema.names]

    return arrays.mapInPandas(solve, schema)


def _regressed(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, target, rcond=None)[0]


def _lags(z: np.ndarray, count: int) -> np.ndarray:
    """Columns of lag 1 to ``count``, zero before the first hour."""
    table = np.zeros((len(z), count))
    for k in range(1, count + 1):
        table[k:, k - 1] = z[: len(z) - k]
    return table


def _first_guess(z: np.ndarray, orders: list[tuple[int, int]], max_p: int, max_q: int) -> np.ndarray:
    """Coefficients (constant, phi, theta) of each pair of orders by two regressions."""
    guess = np.zeros((len(orders), 1 + max_p + max_q))
    n = len(z)
    long = min(20, n // 4)
    ones = np.ones((n, 1))
    lags = np.hstack([ones, _lags(z, long)])[long:]
    shocks = np.zeros(n)
    shocks[long:] = z[long:] - lags @ _regressed(lags, z[long:])
    start = min(long + max_q, n - 1)
    own, before = _lags(z, max_p), _lags(shocks, max_q)
    for row, (p, q) in enumerate(orders):
        columns = [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]
        x = np.hstack([ones, own, before])[:, columns][start:]
        found = _regressed(x, z[start:])
        if not _stationary(-found[None, 1 + p :])[0]:
            found[1 + p :] = 0
        if not _stationary(found[None, 1 : 1 + p])[0]:
            found[1 : 1 + p] = 0
        guess[row, columns] = found
    return guess


def _shocks(
    z: np.ndarray, n: np.ndarray, beta: np.ndarray, active: np.ndarray, max_p: int, max_q: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squared shocks, cross-products of their derivatives, and the last shocks.

    Rows are models: ``z`` repeats a series for each of its orders and is filled up behind ``n``.
    """
    count, width = beta.shape
    theta = beta[:, 1 + max_p :]
    recent = np.zeros((count, max_q))
    slopes = np.zeros((count, max_q, width))
    sse, gram, cross = np.zeros(count), np.zeros((count, width, width)), np.zeros((count, width))
    x = np.ones((count, width))
    for t in range(max_p, z.shape[1]):
        x[:, 1 : 1 + max_p] = z[:, t - max_p : t][:, ::-1]
        x[:, 1 + max_p :] = recent
        there = t < n
        own = x * active
        shock = np.where(there, z[:, t] - (own * beta).sum(axis=1), 0.0)
        slope = -own - np.einsum("cq,cqk->ck", theta, slopes)
        slope[~there] = 0
        sse += shock * shock
        gram += slope[:, :, None] * slope[:, None, :]
        cross += slope * shock[:, None]
        if max_q:
            moved = np.column_stack([shock, recent[:, :-1]])
            recent = np.where(there[:, None], moved, recent)
            slopes = np.where(
                there[:, None, None], np.concatenate([slope[:, None], slopes[:, :-1]], axis=1), slopes
            )
    return sse, gram, cross, recent


def _fitted(z, n, beta, active, max_p, max_q):
    """Gauss-Newton from ``beta``: best coefficients, their sum of squares and last shocks."""
    with np.errstate(all="ignore"):
        best = [beta, *_shocks(z, n, beta, active, max_p, max_q)]
        scale, live = np.ones(len(beta)), np.isfinite(best[1])
        idle = ~active[:, :, None] & np.eye(beta.shape[1], dtype=bool)
        for _ in range(STEPS):
            gram = best[2] + idle
            diagonal = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 1e-300))
            scaled = gram / diagonal[:, :, None] / diagonal[:, None, :]
            live &= np.isfinite(scaled).all(axis=(1, 2))
            scaled[~live] = np.eye(beta.shape[1])
            scaled += 1e-12 * np.eye(beta.shape[1])
            step = np.linalg.solve(scaled, (best[3] / diagonal)[:, :, None])[:, :, 0] / diagonal
            tried = best[0] - np.where(live, scale, 0)[:, None] * np.nan_to_num(step) * active
            found = [tried, *_shocks(z, n, tried, active, max_p, max_q)]
            inside = _stationary(-tried[:, 1 + max_p :]) & np.isfinite(found[1])
            better = live & inside & (found[1] < best[1])
            gain = np.where(better, (best[1] - found[1]) / np.maximum(best[1], 1e-300), np.inf)
            for kept, new in zip(best, found):
                kept[better] = new[better]
            scale = np.where(better, np.minimum(1, 2 * scale), scale / 2)
            live &= (gain > SETTLED) & (scale > 1e-6)
            if not live.any():
                break
    return best[0], best[1], best[4]


def _solve(batch: pd.DataFrame, max_p: int, max_q: int) -> pd.DataFrame:
    """Fit every pair of orders of every series of the batch and keep the best of each."""
    orders = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    series = [np.asarray(z, dtype=float) for z in batch["z"]]
    centre = np.array([z.mean() if len(z) else 0.0 for z in series])
    enough = np.array([len(z) >= 3 * (max_p + max_q) + 4 for z in series])
    total = np.array([((z - c) ** 2).sum() for z, c in zip(series, centre)])
    usable = np.flatnonzero(enough & (total > EXACT_FIT * np.array([(z * z).sum() for z in series])))
    nothing = [None] * len(batch)
    found = {name: list(nothing) for name in ("p", "q", "phi", "theta", "shocks", "intercept", "sigma", "aic")}
    if len(usable):
        length = max(len(series[i]) for i in usable)
        z = np.zeros((len(usable), length))
        for row, i in enumerate(usable):
            z[row, : len(series[i])] = series[i] - centre[i]
        n = np.array([len(series[i]) for i in usable])
        guess = [_first_guess(z[row, : n[row]], orders, max_p, max_q) for row in range(len(usable))]
        active = np.array([
            [True, *[k < p for k in range(max_p)], *[k < q for k in range(max_q)]] for p, q in orders
        ])
        of = np.repeat(np.arange(len(usable)), len(orders))
        beta, sse, shocks = _fitted(
            z[of], n[of], np.concatenate(guess), np.tile(active, (len(usable), 1)), max_p, max_q
        )
        rows = n[of] - max_p
        with np.errstate(all="ignore"):
            aic = rows * np.log(sse / rows) + 2 * (np.tile(active, (len(usable), 1)).sum(axis=1) + 1)
        fits = _stationary(beta[:, 1 : 1 + max_p] * MARGIN ** np.arange(1, max_p + 1))
        fits &= _stationary(-beta[:, 1 + max_p :] * MARGIN ** np.arange(1, max_q + 1))
        fits &= np.isfinite(aic) & (sse > EXACT_FIT * total[usable][of])
        aic = np.where(fits, aic, np.inf).reshape(len(usable), -1)
        for row, i in enumerate(usable):
            k = int(aic[row].argmin())
            if not np.isfinite(aic[row, k]):
                continue
            (p, q), at = orders[k], row * len(orders) + k
            phi = beta[at, 1 : 1 + p]
            chosen = {
                "p": p, "q": q, "phi": phi, "theta": beta[at, 1 + max_p : 1 + max_p + q],
                "shocks": shocks[at, :q], "aic": float(aic[row, k]),
                "intercept": float(beta[at, 0] + centre[i] * (1 - phi.sum())),
                "sigma": float(np.sqrt(sse[at] / (rows[at] - p - q - 1))),
            }
            for name, value in chosen.items():
                found[name][i] = value
    return batch.assign(
        n=[max(0, len(z) - max_p) for z in series],
        **{name: pd.Series(found[name], dtype="Int32") for name in ("p", "q")},
        **{name: pd.Series(found[name], dtype=object) for name in ("phi", "theta", "shocks")},
        **{name: pd.Series(found[name], dtype=float) for name in ("intercept", "sigma", "aic")},
    )
