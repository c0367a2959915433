"""What there is to say about a fitted autoregression: one row per series.

A second pass over the training hours computes every residual from lag windows; Spark sums its
powers and its products with the residuals before it.  The cross-products of the regressors, summed
as for the fit, are inverted for the standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lanescope.operators.autoregression import MAX_P, _moments, cross_products, training_rows

LAGS = 10  # residual autocorrelations that the Ljung-Box statistic takes


def standard_errors(
    split: DataFrame, model: DataFrame, keys: Sequence[str], max_p: int = MAX_P
) -> DataFrame:
    """(keys, intercept_se, phi_se): from the inverse of the regressors' cross-products."""
    keys = list(keys)
    moments = _moments(split, keys, max_p, model.select(*keys, "d")).select(*keys, "center", "moments")
    fitted = moments.join(model.where("phi IS NOT NULL").select(*keys, "p", "sigma"), keys)
    schema = StructType([
        *moments.select(*keys).schema, StructField("intercept_se", DoubleType()),
        StructField("phi_se", ArrayType(DoubleType())),
    ])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = cross_products(batch, max_p)
            constant, lags = [], []
            for gram, p, sigma, center in zip(grams, batch["p"], batch["sigma"], batch["center"]):
                spread = sigma**2 * np.linalg.inv(gram[: p + 1, : p + 1])
                # The intercept of the values themselves, whose lags are not centred.
                moved = np.concatenate([[1.0], np.full(p, -center)])
                constant.append(float(np.sqrt(moved @ spread @ moved)))
                lags.append(np.sqrt(np.diag(spread)[1:]))
            yield batch[keys].assign(intercept_se=constant, phi_se=lags)

    return fitted.mapInPandas(errors, schema)


def residuals(
    split: DataFrame, model: DataFrame, keys: Sequence[str], max_p: int = MAX_P
) -> DataFrame:
    """(keys, place, n, e): the residual of each training hour that has all ``max_p`` lags.

    ``place`` numbers them from 1 to ``n``.
    """
    keys = list(keys)
    in_time = Window.partitionBy(*keys).orderBy("position")
    rows = training_rows(split, keys, model.select(*keys, "d"))
    rows = rows.select(*keys, "position", "d", "z", *[
        F.lag("z", k).over(in_time).alias(f"lag_{k}") for k in range(1, max_p + 1)
    ])
    rows = rows.join(model.where("phi IS NOT NULL").select(*keys, "phi", "intercept", "n"), keys)
    expected = sum(
        (F.coalesce(F.get("phi", F.lit(k - 1)), F.lit(0.0)) * F.col(f"lag_{k}") for k in range(1, max_p + 1)),
        F.col("intercept"),
    )
    place = F.col("position") - F.col("d") - max_p
    return rows.select(*keys, place.alias("place"), "n", (F.col("z") - expected).alias("e")).where("place > 0")


def _chi_square_tail(value: Column, freedom: int) -> Column:
    """Chance of a larger value; exact, as ``freedom`` is even."""
    half = value / 2
    return F.exp(-half) * sum(
        (F.pow(half, F.lit(k)) / factorial(k) for k in range(1, freedom // 2)), F.lit(1.0)
    )


def model_summary(
    split: DataFrame, model: DataFrame, keys: Sequence[str], max_p: int = MAX_P
) -> DataFrame:
    """Coefficients with standard errors and z, fit, and tests of the residuals, for ``fit_ar``.

    Log-likelihood, AIC and BIC count the coefficients, the intercept and the variance.  The
    Ljung-Box statistic takes ten autocorrelations (NULL for ten residuals or fewer);
    ``heteroskedasticity`` is the ratio of the sums of squares of the last and the first third of
    the residuals.  A series without a model has NULLs.
    """
    keys = list(keys)
    in_time = Window.partitionBy(*keys).orderBy("place")
    third = F.floor((F.col("n") + 1) / 3)
    e = F.col("e")
    rows = residuals(split, model, keys, max_p).withColumn(
        "e", e - F.avg("e").over(Window.partitionBy(*keys))
    ).withColumns({f"e_{k}": F.lag("e", k).over(in_time) for k in range(1, LAGS + 1)})
    sums = rows.groupBy(*keys).agg(
        *[F.sum(F.pow(e, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)],
        F.sum(F.when(F.col("place") <= third, e * e)).alias("early"),
        F.sum(F.when(F.col("place") > F.col("n") - third, e * e)).alias("late"),
        *[F.sum(e * F.col(f"e_{k}")).alias(f"r{k}") for k in range(1, LAGS + 1)],
    )
    n, variance = F.col("n"), F.col("s2") / F.col("n")
    joined = model.join(sums, keys, "left").join(standard_errors(split, model, keys, max_p), keys, "left")
    shown = joined.withColumns({
        "log_likelihood": -n / 2 * (F.log(variance) + F.lit(log(2 * pi) + 1)),
        "bic": n * F.log(variance) + (F.col("p") + 2) * F.log(n),
        "skewness": F.col("s3") / n / F.pow(variance, F.lit(1.5)),
        "kurtosis": F.col("s4") / n / (variance * variance),
        "ljung_box": F.when(n > LAGS, n * (n + 2) * sum(
            (F.pow(F.col(f"r{k}") / F.col("s2"), F.lit(2)) / (n - k) for k in range(1, LAGS + 1)), F.lit(0.0)
        )),
        "heteroskedasticity": F.try_divide(F.col("late"), F.col("early")),
    })
    jarque_bera = n / 6 * (F.pow("skewness", F.lit(2)) + F.pow(F.col("kurtosis") - 3, F.lit(2)) / 4)
    shown = shown.withColumn("jarque_bera", jarque_bera)
    coefficients = [
        column for k in range(1, max_p + 1) for column in (
            F.get("phi", F.lit(k - 1)).alias(f"phi_{k}"), F.get("phi_se", F.lit(k - 1)).alias(f"phi_{k}_se"),
            (F.get("phi", F.lit(k - 1)) / F.get("phi_se", F.lit(k - 1))).alias(f"phi_{k}_z"),
        )
    ]
    return shown.select(
        *keys, "p", "d", "n_train", "n", "intercept", "intercept_se",
        (F.col("intercept") / F.col("intercept_se")).alias("intercept_z"), *coefficients, "sigma",
        "log_likelihood", "aic", "bic", "ljung_box",
        _chi_square_tail(F.col("ljung_box"), LAGS).alias("ljung_box_p"), "jarque_bera",
        _chi_square_tail(F.col("jarque_bera"), 2).alias("jarque_bera_p"), "skewness", "kurtosis",
        "heteroskedasticity",
    )
