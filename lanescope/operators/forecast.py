"""Level-of-service forecasts for many hourly series at once.

A series is what shares the key columns; it is regular, one row per hour (``fill_hours``). Split,
fit, backtest and forecast all shuffle by the keys alone.

Two model families share one life cycle:

* ``fit_ar1`` / ``backtest_ar1`` / ``forecast_ar1``: first-order autoregression in closed form,
  built-in aggregates only;
* ``fit_ar`` / ``backtest_ar`` / ``forecast_ar``: order and differencing chosen by AIC, see
  ``autoregression``.

A model that cannot be used (constant series, too few rows, not stationary) forecasts the last
training value and has no interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanescope.schema import MAPE_FLOOR, NORMAL_90, TEST_SHARE

TIME = "datetime"
TRAIN, TEST = "train", "test"


def split_series(
    series: DataFrame, keys: Sequence[str], value: str = "LOS", test_share: float = TEST_SHARE
) -> DataFrame:
    """Number the hours of each series and call the last share of them ``test``.

    Leading NULLs of a gap-filled series are trimmed first. ``hours`` is the series length.
    """
    by_key = Window.partitionBy(*keys)
    numbered = series.where(F.col(value).isNotNull()).select(
        *keys, TIME, F.col(value).alias("y"),
        F.row_number().over(by_key.orderBy(TIME)).alias("position"),
        F.count("*").over(by_key).cast("int").alias("hours"),
    )
    held_out = F.ceil(F.col("hours") * F.lit(float(test_share)))
    return numbered.withColumn(
        "split", F.when(F.col("position") > F.col("hours") - held_out, TEST).otherwise(TRAIN)
    )


def fit_ar1(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: the least-squares line of each training hour on the hour before it.

    ``phi`` and what depends on it are NULL where the line cannot be used.
    """
    # By time, as ``split_series`` numbers them: the hours are sorted once.
    before = F.lag("y").over(Window.partitionBy(*keys).orderBy(TIME))
    fitted = (
        split.where(F.col("split") == TRAIN)
        .withColumn("x", before)
        .groupBy(*keys)
        .agg(
            F.count("*").cast("int").alias("n_train"),
            F.max_by("y", "position").alias("last_y"),
            F.regr_count("y", "x").cast("int").alias("n"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("line_intercept"),
            (F.regr_syy("y", "x") * (1 - F.regr_r2("y", "x"))).alias("line_sse"),
        )
    )
    usable = (F.col("n") >= 3) & (F.abs("slope") < 1)
    sse = F.col("sse")
    return fitted.select(
        *keys, F.lit(1).alias("p"), F.lit(0).alias("d"), "n_train", "n", "last_y",
        F.when(usable, F.col("slope")).alias("phi"),
        F.when(usable, F.col("line_intercept")).alias("intercept"),
        F.when(usable, F.greatest(F.col("line_sse"), F.lit(0.0))).alias("sse"),
    ).select(
        *keys, "p", "d", "n_train", "n", "last_y", "phi", "intercept",
        F.sqrt(F.try_divide(sse, F.col("n") - 2)).alias("sigma"),
        F.when(sse > 0, F.col("n") * F.log(sse / F.col("n")) + 2 * (F.col("p") + 2)).alias("aic"),
    )


def _predict_ar1(rows: DataFrame, ahead: Column) -> DataFrame:
    """Prediction and 90 % interval ``ahead`` hours after training, for rows joined to a model."""
    phi, last_y = F.col("phi"), F.col("last_y")
    mean = F.col("intercept") / (1 - phi)
    half = NORMAL_90 * F.col("sigma") * F.sqrt(
        (1 - F.pow(phi * phi, F.col("_ahead"))) / (1 - phi * phi)
    )
    return (
        rows.withColumn("_ahead", F.when(ahead > 0, ahead))
        .withColumn(
            "_path",
            F.when(
                F.col("_ahead").isNotNull(),
                F.coalesce(mean + F.pow(phi, F.col("_ahead")) * (last_y - mean), last_y),
            ),
        )
        .withColumns({"_lower": F.col("_path") - half, "_upper": F.col("_path") + half})
    )


def backtest_ar1(split: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training data, test data and prediction side by side, one row per hour of each series."""
    rows = split.join(model, list(keys))
    predicted = _predict_ar1(rows, F.col("position") - F.col("n_train"))
    return _backtest_columns(predicted, keys)


def forecast_ar1(split: DataFrame, model: DataFrame, keys: Sequence[str], hours: int) -> DataFrame:
    """Observations, then ``hours`` forecast hours after the last one.

    The model knows the training hours only; it is not refitted, so the forecast starts beyond
    the test hours.
    """
    rows = _with_future(split, hours).join(model, list(keys))
    predicted = _predict_ar1(
        rows, F.when(F.col("step") > 0, F.col("position") + F.col("step") - F.col("n_train"))
    )
    return _forecast_columns(predicted, keys)


def _with_future(split: DataFrame, hours: int) -> DataFrame:
    """Repeat the last row of each series for steps 0 to ``hours``; other rows have step 0."""
    last = F.col("position") == F.col("hours")
    steps = F.when(last, F.sequence(F.lit(0), F.lit(hours))).otherwise(F.array(F.lit(0)))
    return split.withColumn("step", F.explode(steps))


def _backtest_columns(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predicted.select(
        *keys, TIME,
        F.when(F.col("split") == TRAIN, F.col("y")).alias("training_data"),
        F.when(F.col("split") == TEST, F.col("y")).alias("test_data"),
        F.col("_path").alias("prediction"),
        F.col("_lower").alias("lower"), F.col("_upper").alias("upper"),
    )


def _forecast_columns(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predicted.select(
        *keys, (F.col(TIME) + F.col("step") * F.expr("INTERVAL 1 HOUR")).alias(TIME),
        F.when(F.col("step") == 0, F.col("y")).alias("observed"),
        F.col("_path").alias("forecast"),
        F.col("_lower").alias("lower"), F.col("_upper").alias("upper"),
    )


def score(backtest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute percentage error (as a share, not symmetric) and root mean squared error."""
    error = F.col("test_data") - F.col("prediction")
    return (
        backtest.where(F.col("test_data").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_test"),
            F.avg(F.abs(error) / F.greatest(F.abs("test_data"), F.lit(MAPE_FLOOR))).alias("mape"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
        )
    )


def score_observed(backtest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``score`` with the percentage error over hours with traffic only, and the number left out.

    An hour with an observed LOS of 0 has no percentage error; ``score`` divides by a floor there, so
    that one such hour of a quiet camera outweighs all others.  ``mape`` is NULL where every hour is 0.
    """
    seen, error = F.col("test_data") != 0, F.col("test_data") - F.col("prediction")
    return (
        backtest.where(F.col("test_data").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_test"),
            F.count_if(~seen).alias("n_zero"),
            F.avg(F.when(seen, F.abs(error) / F.abs("test_data"))).alias("mape"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
        )
    )
