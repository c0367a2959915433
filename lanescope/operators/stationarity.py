"""How often a series has to be differenced until its level is stationary.

The test is that of Kwiatkowski, Phillips, Schmidt and Shin: the sum of squared cumulative sums of
the deviations from the mean, over a long-run variance with Bartlett weights on ``L`` lags, where
``L`` grows with the root of the series' length.  Weighted autocovariances are not summed lag by lag:
their sum equals that of the squared moving sums over ``L + 1`` hours, which are differences of two
cumulative sums.  Spark groups and orders the hours; a task sees one series after the other, one number
an hour, and sums all levels of differencing in one pass of numpy over it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lanescope.operators.forecast import TRAIN
from lanescope.schema import KPSS_5

MAX_D = 2
#: Share of the squared values below which deviations from the mean count as rounding.
FLAT = 1e-20


def differenced(keys: Sequence[str], d: int, value: str = "z") -> Column:
    """``value`` differenced ``d`` times along a series; NULL in its first ``d`` hours."""
    in_time = Window.partitionBy(*keys).orderBy("position")
    weights = {0: [1], 1: [1, -1], 2: [1, -2, 1]}[d]
    return sum(
        (weight * F.lag(value, k).over(in_time) for k, weight in enumerate(weights) if k),
        F.col(value),
    )


def level_statistics(split: DataFrame, keys: Sequence[str], max_d: int = MAX_D) -> DataFrame:
    """(keys, d, n, lags, statistic) of the training hours differenced 0 to ``max_d`` times.

    ``statistic`` is NULL for a constant series, which has nothing to test, and for one of fewer
    than two values.
    """
    keys = list(keys)
    rows = split.where(F.col("split") == TRAIN).select(*keys, "position", "y")
    schema = StructType([
        *rows.select(*keys).schema, StructField("d", IntegerType()), StructField("n", IntegerType()),
        StructField("lags", IntegerType()), StructField("statistic", DoubleType()),
    ])

    def levels(hours: pa.Table) -> pa.Table:
        y = in_order(hours, "y")
        found = [(d, *_level(np.diff(y, n=d))) for d in range(max_d + 1) if len(y) > d]
        columns = [pa.array(list(x), t) for x, t in zip(zip(*found), LEVEL)]
        named = [hours.column(k).combine_chunks().take(pa.array([0] * len(found))) for k in keys]
        return pa.table([*named, *columns], names=schema.names)

    return rows.groupBy(*keys).applyInArrow(levels, schema)


LEVEL = (pa.int32(), pa.int32(), pa.int32(), pa.float64())


def in_order(hours: pa.Table, name: str) -> np.ndarray:
    """A column of one series as numbers, in the order of its positions."""
    position, values = (hours.column(c).to_numpy() for c in ("position", name))
    if (position[1:] < position[:-1]).any():
        values = values[np.argsort(position, kind="stable")]
    return values.astype(float)


def _level(w: np.ndarray) -> tuple[int, int, float | None]:
    """Number of values, lags and the statistic of one series."""
    n = len(w)
    e = w - w.mean()
    c = np.cumsum(e)
    lags = int(3 * np.sqrt(n) / 13)
    if n < 2 or e @ e <= FLAT * (w @ w):
        return n, lags, None
    # Moving sums that end behind the series too: 0 less the cumulative sum before it.
    moving = np.concatenate([c, np.zeros(lags + 1)])
    moving[lags + 1 :] -= c
    return n, lags, float((c @ c) * (lags + 1) / (n * (moving @ moving)))


def choose_d(split: DataFrame, keys: Sequence[str], max_d: int = MAX_D) -> DataFrame:
    """One row per series: the statistic at each level and ``d``, how often to difference.

    ``d`` is the least number of times after which a stationary level is not rejected at five in a
    hundred, or after which nothing varies; ``max_d`` if there is none below it.
    """
    passed = F.col("statistic").isNull() | (F.col("statistic") <= KPSS_5)
    found = level_statistics(split, keys, max_d)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("d") == d, F.col("statistic"))).alias(f"level_{d}") for d in range(max_d + 1)],
        F.max(F.when(F.col("d") == 0, F.col("n"))).alias("n"),
        F.max(F.when(F.col("d") == 0, F.col("lags"))).alias("lags"),
        F.coalesce(F.min(F.when(passed, F.col("d"))), F.lit(max_d)).alias("d"),
    )
