"""Facts from stored state against facts from all raw rows."""

import pytest
from conftest import SMALL, at
from pyspark.sql import functions as F

import __spark_entry__ as registry
from compare import differences
from lanescope import Slicer, plans
from lanescope.operators import facts, state
from lanescope.sources import fixtures

KINDS = {
    "event": (fixtures.events, state.event_state, state.event_facts_from, facts.event_facts),
    "volume": (fixtures.volumes, state.volume_state, state.volume_facts_from, facts.volume_facts),
}


def same(left, right):
    assert left.columns == right.columns and left.dtypes == right.dtypes
    assert differences(left.toPandas(), right.toPandas()) is None


@pytest.mark.parametrize("kind", KINDS)
def test_late_rows_change_their_days_only(spark, tmp_path, kind):
    table, state_of, facts_from, facts_of = KINDS[kind]
    rows, cameras = table(spark, SMALL).cache(), fixtures.cameras(spark, SMALL)
    lake, scratch = str(tmp_path / "lake"), str(tmp_path / "scratch")
    days = [r.day for r in rows.select(F.to_date("time").alias("day")).distinct().orderBy("day").collect()]
    chosen = days[len(days) // 2 : len(days) // 2 + 2]
    late = F.to_date("time").isin(*chosen) & (F.pmod(F.xxhash64("time", "camera_id"), F.lit(3)) == 0)
    assert plans.read_state(spark, lake) is None
    assert plans.add_to_state(state_of(rows.where(~late)), lake, scratch) == days
    files = {f for f in plans.read_state(spark, lake).inputFiles()}
    assert plans.add_to_state(state_of(rows.where(late)), lake, scratch) == chosen
    now = {f for f in plans.read_state(spark, lake).inputFiles()}
    changed = {f for f in files ^ now if "day=" in f}
    assert changed and all(any(f"day={day}/" in f for day in chosen) for f in changed)
    stored = plans.read_state(spark, lake)
    same(facts_from(stored, cameras, registry.WIDE), facts_of(rows, cameras, registry.WIDE))
    # Another selection needs no raw rows, and its hours read their own days.
    narrow = Slicer(["ASIA"], ["IN"], registry.NARROW.start, registry.NARROW.end, day_column="day")
    plain = Slicer(["ASIA"], ["IN"], registry.NARROW.start, registry.NARROW.end)
    found = facts_from(stored, cameras, narrow)
    same(found, facts_of(rows, cameras, plain))
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()
    # Nothing new changes nothing; corrected days are replaced.
    assert plans.add_to_state(state_of(rows.limit(0)), lake, scratch) == []
    whole = state_of(rows.where(F.to_date("time") == chosen[0]))
    plans.replace_days(whole, lake)
    same(facts_from(plans.read_state(spark, lake), cameras, registry.WIDE), facts_of(rows, cameras, registry.WIDE))
    rows.unpersist()


def test_merging_is_exact_in_any_order(spark, volumes_of, events_of, cameras_of):
    cameras = cameras_of((1, "E", "R", 1.0, 2.0), (1, "E", "R", 1.0, 2.0))
    slicer = Slicer(["R"], ["IN"])
    rows = [
        (at(1), 1, "IN", "b2t_1", "car", 2, 50.0), (at(1), 1, "IN", "b2t_2", "car", 1, 70.0),
        (at(1), 1, "IN", "b2t_1", "ALL", 5, -1.0), (at(1), 1, "IN", "b2t_3", "ALL", 5, None),
        (at(1), 1, "IN", "b2t_1", "motorbike", 3, 20.0), (at(1), 1, "IN", None, "bus", None, 5.0),
        (None, 1, "IN", "b2t_1", "car", 9, 9.0), (at(2), 1, "IN", "t2b_1", "motorbike", 1, -1.0),
    ]
    whole = facts.volume_facts(volumes_of(*rows), cameras, slicer)
    for cut in range(len(rows) + 1):
        parts = [state.volume_state(volumes_of(*x)) for x in (rows[cut:], rows[:cut]) if x]
        same(state.volume_facts_from(state.merged(*parts), cameras, slicer), whole)
    said = [
        (at(1), 1, "IN", "z", "accident", "car", f'"confidence":{c}') for c in ("0.3333", "0.3333", "0.3334", "x")
    ] + [(at(1), 1, "IN", "z", "accident", "car", None), (at(1), 1, "IN", "z", "error", "car", "x")]
    whole = facts.event_facts(events_of(*said), cameras, slicer)
    for cut in range(1, len(said)):
        parts = [state.event_state(events_of(*x)) for x in (said[:cut], said[cut:])]
        same(state.event_facts_from(state.merged(*parts), cameras, slicer), whole)


def test_state_of_no_rows(spark, volumes_of, events_of, cameras_of):
    cameras, slicer = cameras_of((1, "E", "R", 1.0, 2.0)), Slicer(["R"], ["IN"])
    volumes = spark.createDataFrame([], fixtures.VOLUMES)
    events = spark.createDataFrame([], fixtures.EVENTS)
    assert state.volume_facts_from(state.volume_state(volumes), cameras, slicer).count() == 0
    assert state.event_facts_from(state.event_state(events), cameras, slicer).count() == 0
