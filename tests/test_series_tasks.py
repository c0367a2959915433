"""Many series: what one task holds is bounded, however few observations the hours come from."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from test_forecast import KEYS, table

import __spark_entry__ as registry
from conftest import MEDIUM
from lanescope.operators import autoregression, forecast, hourly, stationarity


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_series_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(hourly, "SERIES_PER_TASK", 10)
    found = registry._split(spark, MEDIUM, registry.CAMERA_SERIES)
    tasks = found.rdd.mapPartitions(lambda rows: [len({r.series for r in rows})]).collect()
    assert sum(tasks) > 150 and len(tasks) == 21
    assert max(tasks) <= 30  # before: all of them in one or two tasks


def test_parts_change_no_row(spark):
    first = datetime(2024, 1, 1)
    rows = [(f"k{k}", first + timedelta(hours=h), float(h * k)) for k in range(7) for h in range(k, 60, k + 3)]
    observed = spark.createDataFrame(rows, "k string, datetime timestamp_ntz, y double")
    plain, dealt = (hourly.fill_hours(observed, KEYS, "y", parts) for parts in (None, 5))
    assert sorted(plain.collect(), key=str) == sorted(dealt.collect(), key=str)


def test_no_hour_is_copied_to_choose_and_fit(spark):
    split = forecast.split_series(table(spark, a=range(40), b=range(50)), KEYS)
    chosen = stationarity.choose_d(split, KEYS)
    model = autoregression.fit_ar(split, KEYS, d=chosen)
    assert "Generate" not in plan_of(chosen) and "Generate" not in plan_of(model)
    # A join would sort the hours again.
    assert "Join" not in plan_of(model)


def test_short_and_unknown_series(spark):
    split = forecast.split_series(table(spark, a=[1.0, 2.0, 4.0], b=[3.0] * 3, c=[5.0, 1.0, 2.0, 9.0] * 30), KEYS)
    levels = {(r.k, r.d): r.n for r in stationarity.level_statistics(split, KEYS).collect()}
    assert levels == {("a", 0): 2, ("a", 1): 1, ("b", 0): 2, ("b", 1): 1, **{("c", d): 84 - d for d in range(3)}}
    only = spark.createDataFrame([("a", 2), ("c", 1), ("other", 0)], "k string, d int")
    rows = {r.k: r for r in autoregression.fit_ar(split, KEYS, d=only).collect()}
    assert sorted(rows) == ["a", "c"] and rows["a"].phi is None and rows["a"].tail == [1.0, 2.0]
    assert (rows["c"].d, rows["c"].n_train, rows["c"].n_test) == (1, 84, 36)


def test_products_are_those_of_the_lags(spark):
    z = np.random.default_rng(3).normal(5, 1, 40)
    center, found = autoregression._products(z, 2)
    own = z - z.mean()
    x = np.stack([np.ones(38), own[1:-1], own[:-2], own[2:]])
    assert center == pytest.approx(z.mean())
    assert found == pytest.approx((x @ x.T)[np.triu_indices(4)])
