"""Autoregressive models of chosen order, one per series.

The model is an autoregression of order 0 to ``max_p`` on the ``d`` times differenced series, by
least squares, the order with the least AIC. All orders are fitted on the same rows, those with all
``max_p`` lags, so that their AICs compare. ``d`` is given, or chosen for each series by
``stationarity.choose_d``. Moving-average terms are in ``arma``, whose models the same backtest and
forecast serve.

Spark groups and orders the hours; a task sees one series after the other, one number an hour, and
reduces it to the cross-products of its lags; every order's normal equations are a corner of that one
small matrix. They are solved for many series per call, so that arithmetic is vectorised over series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
    TimestampNTZType,
)

from lanescope.operators.forecast import (
    TIME,
    TRAIN,
    _backtest_columns,
    _forecast_columns,
)
from lanescope.operators.stationarity import MAX_D, differenced, in_order
from lanescope.schema import NORMAL_90

MAX_P = 5
SINGULAR = 1e12  # condition number from which normal equations count as singular
EXACT_FIT = 1e-12  # share of the variance below which a residual counts as rounding
CHUNK = 1_000_000  # forecast cells computed at a time


def training_rows(split: DataFrame, keys: Sequence[str], d: int | DataFrame) -> DataFrame:
    """Training hours with ``d`` and ``z``, the value differenced so often.

    ``d`` is a number or a table of keys and ``d``, as ``stationarity.choose_d`` returns it.
    """
    rows = split.where(F.col("split") == TRAIN).withColumn("z", F.col("y"))
    if isinstance(d, int):
        return rows.withColumns({"d": F.lit(d), "z": differenced(keys, d)})
    rows = rows.join(d.select(*keys, "d"), list(keys))
    levels = [F.when(F.col("d") == k, differenced(keys, k)) for k in range(MAX_D + 1)]
    return rows.withColumn("z", F.coalesce(*levels))


def _moments(split: DataFrame, keys: Sequence[str], max_p: int, d: int | DataFrame) -> DataFrame:
    """Per series: cross-products of (1, lag 1 ... lag max_p, value) and the last training values."""
    keys = list(keys)
    rows = split.where(F.col("split") == TRAIN).select(*keys, "position", "y", "hours", TIME)
    schema = StructType([
        *rows.select(*keys).schema,
        *[StructField(name, IntegerType()) for name in ("d", "n_train", "n_test")],
        StructField("last_y", DoubleType()), StructField("last_time", TimestampNTZType()),
        StructField("center", DoubleType()), StructField("moments", ArrayType(DoubleType())),
        StructField("tail", ArrayType(DoubleType())),
    ])

    def row(hours: pa.Table, found: list[tuple]) -> pa.Table:
        named = [hours.column(k).combine_chunks().slice(0, len(found)) for k in keys]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(MOMENTS)]
        return pa.table([*named, *columns], names=schema.names)

    def reduced(hours: pa.Table, level: int) -> pa.Table:
        y = in_order(hours, "y")
        n_test = hours.column("hours")[0].as_py() - len(y)
        center, moments = _products(np.diff(y, n=level), max_p)
        last_time = pc.max(hours.column(TIME)).as_py()
        tail = y[max(0, len(y) - max_p - level) :]
        return row(hours, [(level, len(y), n_test, y[-1], last_time, center, moments, tail)])

    if isinstance(d, int):
        return rows.groupBy(*keys).applyInArrow(lambda hours: reduced(hours, d), schema)

    def chosen(hours: pa.Table, levels: pa.Table) -> pa.Table:
        if not hours.num_rows or not levels.num_rows:
            return row(hours, [])
        return reduced(hours, levels.column("d")[0].as_py())

    levels = d.select(*keys, "d").dropna()
    return rows.groupBy(*keys).cogroup(levels.groupBy(*keys)).applyInArrow(chosen, schema)


MOMENTS = (
    pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.timestamp("us"), pa.float64(),
    pa.list_(pa.float64()), pa.list_(pa.float64()),
)


def _products(z: np.ndarray, max_p: int) -> tuple[float | None, np.ndarray]:
    """Mean of ``z`` and the products, summed, of (1, its lags, itself) in rows with all lags."""
    n, size = len(z) - max_p, max_p + 2
    if not len(z):
        return None, np.zeros(size * (size + 1) // 2)
    center = z.mean()
    z = z - center  # centred values keep the cross-products well conditioned
    vector = np.ones((size, max(n, 0)))
    for k in range(max_p + 1) if n > 0 else ():
        vector[-1 if k == 0 else k] = z[max_p - k : len(z) - k]
    return float(center), (vector @ vector.T)[np.triu_indices(size)]


def fit_ar(
    split: DataFrame, keys: Sequence[str], max_p: int = MAX_P, d: int | DataFrame = 0
) -> DataFrame:
    """One row per series: order, coefficients, residual deviation, AIC and row counts.

    ``d`` is 0, 1 or 2 for all series, or a table with the ``d`` of each (``stationarity.choose_d``).
    ``phi`` is NULL where no order can be used: a constant series or one with too few rows. Orders
    that are singular or not stationary are left out of the choice.
    """
    if isinstance(d, int) and not 0 <= d <= MAX_D:
        raise ValueError("d is 0, 1 or 2")
    moments = _moments(split, keys, max_p, d)
    schema = StructType([
        *moments.select(*keys).schema,
        StructField("p", IntegerType()),
        StructField("d", IntegerType()),
        StructField("n_train", IntegerType()),
        StructField("n_test", IntegerType()),
        StructField("n", IntegerType()),
        StructField("last_y", DoubleType()),
        StructField("phi", ArrayType(DoubleType())),
        StructField("intercept", DoubleType()),
        StructField("sigma", DoubleType()),
        StructField("aic", DoubleType()),
        StructField("tail", ArrayType(DoubleType())),
        StructField("last_time", TimestampNTZType()),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _solve(batch, max_p)[schema.names]

    return moments.mapInPandas(solve, schema)


def cross_products(batch: pd.DataFrame, max_p: int) -> np.ndarray:
    """The symmetric matrices of the ``moments`` of each series."""
    size = max_p + 2
    grams = np.zeros((len(batch), size, size))
    upper = np.triu_indices(size)
    if len(batch):
        grams[:, upper[0], upper[1]] = np.stack(batch["moments"].to_numpy())
        grams[:, upper[1], upper[0]] = grams[:, upper[0], upper[1]]
    return grams


def _solve(batch: pd.DataFrame, max_p: int) -> pd.DataFrame:
    """Solve every order for every series of the batch and keep the best order of each."""
    count = len(batch)
    grams = cross_products(batch, max_p)
    n, total = grams[:, 0, 0], grams[:, -1, -1]
    best = {
        "aic": np.full(count, np.inf), "p": np.zeros(count, dtype=int),
        "phi": np.zeros((count, max_p)), "constant": np.zeros(count), "sse": np.zeros(count),
    }
    for p in range(max_p + 1):
        left, right = grams[:, : p + 1, : p + 1], grams[:, : p + 1, -1]
        scale = np.sqrt(np.maximum(np.diagonal(left, axis1=1, axis2=2), 1e-300))
        scaled = left / scale[:, :, None] / scale[:, None, :]
        usable = (n >= max_p + 3) & (np.linalg.cond(scaled) < SINGULAR)
        scaled[~usable] = np.eye(p + 1)
        solution = np.linalg.solve(scaled, (right / scale)[:, :, None])[:, :, 0] / scale
        sse = total - (solution * right).sum(axis=1)
        usable &= sse > EXACT_FIT * total
        usable &= _stationary(solution[:, 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = n * np.log(sse / n) + 2 * (p + 2)
        better = usable & (aic < best["aic"])
        best["aic"][better], best["p"][better], best["sse"][better] = aic[better], p, sse[better]
        best["constant"][better] = solution[better, 0]
        best["phi"][better] = 0
        best["phi"][better, :p] = solution[better, 1:]
    found = np.isfinite(best["aic"])
    freedom = np.where(found, n - best["p"] - 1, 1)
    center = batch["center"].to_numpy(dtype=float)
    intercept = best["constant"] + center * (1 - best["phi"].sum(axis=1))
    blank = np.where(found, 0.0, np.nan)
    return batch.assign(
        n=n.astype(int),
        p=pd.Series(best["p"], index=batch.index, dtype="Int32").where(found),
        phi=[row[:p] if ok else None for row, p, ok in zip(best["phi"], best["p"], found)],
        intercept=intercept + blank,
        sigma=np.sqrt(best["sse"] / freedom) + blank,
        aic=np.where(found, best["aic"], np.nan),
    )


def _stationary(phi: np.ndarray) -> np.ndarray:
    """Whether all roots of each row's characteristic polynomial lie inside the unit circle."""
    count, p = phi.shape
    if p == 0:
        return np.ones(count, dtype=bool)
    companion = np.zeros((count, p, p))
    companion[:, 0, :] = phi
    companion[:, np.arange(1, p), np.arange(p - 1)] = 1
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1


def _paths(model: DataFrame, keys: Sequence[str], extra: int = 0) -> DataFrame:
    """Predictions of the test hours or, with ``extra``, of so many hours after them only.

    ``_at`` is the hour's position in its series, ``_time`` the hour itself.
    """
    keys = list(keys)
    schema = StructType([
        *model.select(*keys).schema,
        StructField("_at", IntegerType()),
        StructField("_time", TimestampNTZType()),
        StructField("_path", DoubleType()),
        StructField("_half", DoubleType()),
    ])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tested = batch["n_test"].to_numpy()
            reach = tested + extra
            skipped = tested if extra else np.zeros_like(tested)
            # Series of similar reach go together; a chunk's table stays below CHUNK cells.
            order, start = np.argsort(-reach, kind="stable"), 0
            while start < len(order) and reach[order[start]] > 0:
                rows = max(1, CHUNK // int(reach[order[start]]))
                chosen = order[start : start + rows]
                yield _predict(batch.iloc[chosen], skipped[chosen], reach[chosen], keys)
                start += rows

    columns = [*keys, "d", "n_train", "n_test", "last_y", "phi", "intercept", "sigma", "tail",
               "last_time", *[c for c in ("theta", "shocks") if c in model.columns]]
    return model.select(*columns).mapInPandas(predict, schema)


def _predict(
    batch: pd.DataFrame, skipped: np.ndarray, reach: np.ndarray, keys: list[str]
) -> pd.DataFrame:
    """Run the recursion for all series at once; a row per hour ahead, beyond those skipped.

    Models with ``theta`` carry the last ``shocks``, newest first; they act as long as they last.
    """
    count, steps = len(batch), int(reach.max())
    found = batch["phi"].notna().to_numpy()
    weights = [
        _on_levels(phi, d) if ok else np.array([1.0])
        for phi, d, ok in zip(batch["phi"], batch["d"], found)
    ]
    width = max([1, *map(len, weights)])
    lags, past = np.zeros((count, width)), np.zeros((count, width))
    for row, (own, tail, last_y) in enumerate(zip(weights, batch["tail"], batch["last_y"])):
        lags[row, : len(own)] = own
        recent = np.asarray(tail if tail is not None and len(tail) else [last_y])[::-1][:width]
        past[row, : len(recent)] = recent
    theta, shocks = (_padded(batch.get(name), count) for name in ("theta", "shocks"))
    drift = np.where(found, batch["intercept"].to_numpy(dtype=float), 0.0)
    path, spread = np.empty((count, steps)), np.empty((count, steps))
    response = np.zeros((count, width))  # effect of one shock on the latest hours
    response[:, 0] = 1.0
    variance = np.ones(count)
    for step in range(steps):
        path[:, step] = drift + (lags * past).sum(axis=1)
        path[:, step] += (theta[:, step:] * shocks[:, : max(0, shocks.shape[1] - step)]).sum(axis=1)
        past = np.column_stack([path[:, step], past[:, :-1]])
        spread[:, step] = np.sqrt(variance)
        own = (lags * response).sum(axis=1) + (theta[:, step] if step < theta.shape[1] else 0.0)
        response = np.column_stack([own, response[:, :-1]])
        variance = variance + response[:, 0] ** 2
    sigma = np.where(found, batch["sigma"].to_numpy(dtype=float), np.nan)
    half = NORMAL_90 * sigma[:, None] * spread
    ahead = np.arange(1, steps + 1)
    wanted = (ahead[None, :] <= reach[:, None]) & (ahead[None, :] > skipped[:, None])
    rows = np.repeat(np.arange(count), reach - skipped)
    out = batch[keys].iloc[rows].reset_index(drop=True)
    at = batch["n_train"].to_numpy()[:, None] + ahead[None, :]
    hours = (ahead * np.timedelta64(1, "h"))[None, :]
    time = batch["last_time"].to_numpy(dtype="datetime64[ns]")[:, None] + hours
    return out.assign(
        _at=at[wanted], _time=time[wanted], _path=path[wanted], _half=half[wanted]
    )


def _padded(lists: pd.Series | None, count: int) -> np.ndarray:
    """Lists of numbers as rows of a table, filled up with zeros."""
    rows = [] if lists is None else [[] if row is None else list(row) for row in lists]
    table = np.zeros((count, max([0, *map(len, rows)])))
    for i, row in enumerate(rows):
        table[i, : len(row)] = row
    return table


def _on_levels(phi: Sequence[float], d: int) -> np.ndarray:
    """Lag weights on the undifferenced series: the product with ``d`` unit-root factors."""
    polynomial = np.concatenate([[1.0], -np.asarray(phi, dtype=float)])
    for _ in range(d):
        polynomial = np.convolve(polynomial, [1.0, -1.0])
    return -polynomial[1:] if len(polynomial) > 1 else np.array([0.0])


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "_lower": F.col("_path") - F.col("_half"), "_upper": F.col("_path") + F.col("_half"),
    })


def _without_path(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return rows.withColumns({"_path": nothing, "_half": nothing})


def backtest_ar(split: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training data, test data and prediction side by side, one row per hour of each series.

    Only test hours are joined with predictions; training hours have none.
    """
    names = [*keys, TIME, "y", "split", "_path", "_half"]
    tested = split.where(F.col("split") != TRAIN).withColumn("_at", F.col("position"))
    tested = tested.join(_paths(model, keys).drop("_time"), [*keys, "_at"], "left")
    trained = _without_path(split.where(F.col("split") == TRAIN))
    return _backtest_columns(_bounds(trained.select(*names).union(tested.select(*names))), keys)


def forecast_ar(split: DataFrame, model: DataFrame, keys: Sequence[str], hours: int) -> DataFrame:
    """Observations, then ``hours`` forecast hours after the last one, without a refit.

    The model knows where a series ends, so that nothing is joined: the forecast hours are appended.
    """
    names = [*keys, TIME, "y", "step", "_path", "_half"]
    seen = _without_path(split).withColumn("step", F.lit(0)).select(*names)
    ahead = _paths(model, keys, hours).withColumns({
        TIME: F.col("_time"), "y": F.lit(None).cast("double"), "step": F.lit(0),
    })
    return _forecast_columns(_bounds(seen.union(ahead.select(*names))), keys)
