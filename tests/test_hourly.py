"""Gap filling and smoothing by hand, by loops over hours and, on made-up cells, against pandas."""

from datetime import timedelta

import pandas as pd
import pytest
from conftest import SMALL, at
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as registry
from lanescope.operators import facts, hourly
from lanescope.sources import fixtures

SERIES = "datetime TIMESTAMP_NTZ, k STRING, y DOUBLE"


def wide(table, key, value):
    frame = table.toPandas()
    return frame.pivot(index="datetime", columns=key, values=value).sort_index()


def test_fill_and_rolling_mean_by_hand(spark):
    observed = spark.createDataFrame(
        [(at(h), "a", float(y)) for h, y in ((0, 1), (1, 2), (4, 3), (5, 4))]
        + [(at(4), "late", 7.0), (at(5), "late", 8.0), (at(2), "late", None)], SERIES,
    )
    filled = hourly.rolling_mean(hourly.fill_hours(observed, ["k"], "y"), ["k"], "y", 3, "mean3")
    rows = {(r.k, r.datetime.hour): r for r in filled.collect()}
    assert len(rows) == 12
    assert [rows["a", h].y for h in range(6)] == [1, 2, 2, 2, 3, 4]
    assert [rows["a", h].gap for h in range(6)] == [False, False, True, True, False, False]
    means = [rows["a", h].mean3 for h in range(6)]
    assert means[:2] == [None, None]
    assert means[2:] == pytest.approx([5 / 3, 2, 7 / 3, 3])
    assert [rows["late", h].y for h in range(6)] == [None] * 4 + [7, 8]
    assert [rows["late", h].mean3 for h in range(6)] == [None] * 6


def test_counts_are_zero_in_observed_hours_and_repeat_in_gaps(spark):
    counts = spark.createDataFrame(
        [(at(0), "a", 5), (at(0), "b", 2), (at(1), "b", 3), (at(4), "a", 1)],
        "datetime TIMESTAMP_NTZ, k STRING, n BIGINT",
    )
    rows = {(r.k, r.datetime.hour): (r.n, r.gap) for r in hourly.fill_counts(counts, "k", "n").collect()}
    assert [rows["a", h] for h in range(5)] == [
        (5, False), (0, False), (0, True), (0, True), (1, False),
    ]
    assert [rows["b", h] for h in range(5)] == [
        (2, False), (3, False), (3, True), (3, True), (0, False),
    ]


def test_empty_series(spark):
    empty = spark.createDataFrame([], SERIES)
    assert hourly.fill_hours(empty, ["k"], "y").count() == 0
    assert hourly.fill_counts(empty, "k", "y").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(
    st.tuples(st.sampled_from("abc"), st.integers(0, 40)),
    st.one_of(st.none(), st.floats(-9, 9)), min_size=1, max_size=25,
))
def test_fill_equals_pandas(spark, cells):
    if all(y is None for y in cells.values()):
        return
    data = [(at(h % 24, day=1 + h // 24), k, y) for (k, h), y in cells.items()]
    ours = wide(hourly.fill_hours(spark.createDataFrame(data, SERIES), ["k"], "y"), "k", "y")
    frame = pd.DataFrame(data, columns=["datetime", "k", "y"]).dropna()
    expected = frame.pivot(index="datetime", columns="k", values="y").asfreq("h").ffill()
    assert ours.index.tolist() == expected.index.tolist()
    pd.testing.assert_frame_equal(
        ours, expected, check_freq=False, check_names=False, check_index_type=False,
        check_dtype=False,
    )


@pytest.fixture(scope="module")
def event_rows(spark):
    return facts.event_facts(
        fixtures.events(spark, SMALL), fixtures.cameras(spark, SMALL), registry.WIDE
    ).cache()


HOUR = timedelta(hours=1)


def hours_of(cells):
    """Every hour from the first to the last of the cells' (hour, key)."""
    first, last = min(h for h, _ in cells), max(h for h, _ in cells)
    return [first + k * HOUR for k in range(int((last - first) / HOUR) + 1)]


def carried(cells, key, hours):
    """The key's values in each hour, gaps with the one before; None before the first."""
    found, latest = [], None
    for hour in hours:
        latest = cells.get((hour, key), latest)
        found.append(latest)
    return found


def test_hourly_confidence_by_loops(event_rows):
    said = {}
    for r in event_rows.collect():
        if r.confidence is not None:
            said.setdefault((r.datetime, r.event_type), []).append(r.confidence)
    cells = {cell: sum(x) / len(x) for cell, x in said.items()}
    hours = hours_of(cells)
    ours = {(r.datetime, r.event_type): r for r in hourly.hourly_confidence(event_rows).collect()}
    kinds = {kind for _, kind in cells}
    assert set(ours) == {(hour, kind) for hour in hours for kind in kinds}
    for kind in kinds:
        values = carried(cells, kind, hours)
        for at_, hour in enumerate(hours):
            row, last = ours[hour, kind], values[max(0, at_ - 2) : at_ + 1]
            assert row.confidence == (None if values[at_] is None else pytest.approx(values[at_]))
            whole = len(last) == 3 and None not in last
            assert row.smoothed == (pytest.approx(sum(last) / 3) if whole else None)


@pytest.mark.parametrize("direction", ["IN", "OUT"])
def test_hourly_counts_by_loops(event_rows, direction):
    seen, cells = set(), {}
    for r in event_rows.where(f"direction = '{direction}'").collect():
        if r.event_type is not None:
            seen.add(r.datetime)
            cells[r.datetime, r.event_type] = cells.get((r.datetime, r.event_type), 0) + 1
    kinds = {kind for _, kind in cells}
    # In an hour with any row, a type without one counts 0; only whole gaps repeat the hour before.
    cells |= {(hour, kind): 0 for hour in seen for kind in kinds if (hour, kind) not in cells}
    hours = hours_of(cells)
    expected = {(hour, kind): n for kind in kinds for hour, n in zip(hours, carried(cells, kind, hours))}
    ours = hourly.hourly_event_count(event_rows, direction).collect()
    assert {(r.datetime, r.event_type): r.events for r in ours} == expected and len(ours) == len(expected)


def test_hourly_los_by_loops_for_many_series(spark):
    rows = facts.volume_facts(
        fixtures.volumes(spark, SMALL), fixtures.cameras(spark, SMALL), registry.WIDE
    ).cache()
    for keys in (["destination"], ["destination", "camera_id"]):
        levels = {}
        for r in rows.collect():
            if r.LOS is not None:
                levels.setdefault((r.datetime, tuple(r[k] for k in keys)), []).append(r.LOS)
        cells = {cell: sum(x) / len(x) for cell, x in levels.items()}
        hours, names = hours_of(cells), {key for _, key in cells}
        ours = hourly.hourly_los(rows, keys).collect()
        assert len(ours) == len(hours) * len(names)
        found = {(r.datetime, tuple(r[k] for k in keys)): r.LOS for r in ours}
        for key in names:
            values = carried(cells, key, hours)
            assert [found[hour, key] for hour in hours] == [
                None if x is None else pytest.approx(x) for x in values
            ]
    rows.unpersist()
