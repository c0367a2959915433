"""Counts and cross-tabs against pandas on the same facts."""

import pandas as pd
import pytest
from conftest import SMALL, at

import __spark_entry__ as registry
from lanescope.functions import widen
from lanescope.operators import events, facts
from lanescope.sources import fixtures

FACTS = (
    "datetime TIMESTAMP_NTZ, address STRING, camera_id BIGINT, direction STRING, zone STRING, "
    "event_type STRING, item_type STRING, confidence DOUBLE"
)


@pytest.fixture(scope="module")
def rows(spark):
    table = facts.event_facts(
        fixtures.events(spark, SMALL), fixtures.cameras(spark, SMALL), registry.WIDE
    )
    # Rows with missing keys, as a wider source may hold them.
    odd = spark.createDataFrame([
        (at(3), "ASIA", None, "IN", "b2t_1", "error", "car", None),
        (at(3), "ASIA", 1, "IN", "b2t_1", None, "car", 0.5),
        (at(3), "ASIA", 1, "IN", "b2t_1", "accident", None, 0.5),
        (at(3), "ASIA", 1, "OUT", None, "accident", "car", 0.25),
    ], FACTS)
    return table.union(odd).cache()


@pytest.fixture(scope="module")
def frame(rows):
    return rows.toPandas()


def indexed(table, *keys):
    return table.toPandas().set_index(list(keys)).sort_index()


def test_total_and_counts(rows, frame):
    assert events.event_total(rows).first().events == len(frame)
    expected = {}
    for kind, camera in zip(frame.event_type, frame.camera_id):
        if pd.notna(kind):
            expected[kind] = expected.get(kind, 0) + pd.notna(camera)
    assert {r.event_type: r.events for r in events.event_count_by_type(rows).collect()} == expected


def test_confidence_by_type(rows, frame):
    said = {}
    for kind, value in zip(frame.event_type, frame.confidence):
        if pd.notna(kind) and pd.notna(value):
            said.setdefault(kind, []).append(value)
    ours = {r.event_type: r for r in events.confidence_by_type(rows).collect()}
    assert set(ours) == set(said)
    for kind, values in said.items():
        mean = sum(values) / len(values)
        assert ours[kind].confidence == pytest.approx(mean)
        assert ours[kind].percent == pytest.approx(100 * mean, abs=0.00501)


def test_counts_of_a_few_rows(spark):
    few = spark.createDataFrame([
        (at(1), "R", 4, "IN", "b2t_1", "accident", "car", 0.5),
        (at(1), "R", 4, "IN", "b2t_1", "accident", "van", 0.25),
        (at(2), "R", 9, "IN", "t2b_1", "error", "car", None),
        (at(2), "R", None, "IN", "t2b_1", "error", "car", None),
    ], FACTS)
    assert events.event_total(few).first().events == 4
    assert {tuple(r) for r in events.event_count_by_type(few).collect()} == {("accident", 2), ("error", 1)}
    assert [tuple(r) for r in events.confidence_by_type(few).collect()] == [("accident", 0.375, 37.5)]
    frequent = [(r.camera_id, r.events) for r in events.event_frequency_by_camera(few).collect()]
    assert frequent[0] == (4, 2) and set(frequent[1:]) == {(9, 1), (None, 1)}


def counted(frame, key):
    """Every observed key with every observed type, counted by hand."""
    pairs = [(k, t) for k, t in zip(frame[key], frame.event_type) if pd.notna(k) and pd.notna(t)]
    keys, types = {k for k, _ in pairs}, {t for _, t in pairs}
    return {(k, t): pairs.count((k, t)) for k in keys for t in types}


def long_counts(table, key):
    return {(r[key], r.event_type): r.events for r in table.collect()}


def test_count_by_camera(rows, frame):
    assert long_counts(events.event_count_by_camera(rows), "camera_id") == counted(frame, "camera_id")


def test_an_unknown_type_is_counted_and_no_list_drops_it(spark, rows, frame):
    new = spark.createDataFrame([(at(4), "ASIA", 77, "IN", "b2t_9", "flood", "boat", 0.75)], FACTS)
    both = rows.union(new)
    counts = long_counts(events.event_count_by_camera(both), "camera_id")
    assert counts[77, "flood"] == 1 and counts[77, "error"] == 0
    assert long_counts(events.lane_count_b2t(both), "zone")["b2t_9", "flood"] == 1
    shares = {(r.event_type, r.item_type): (r.confidence, r.percent)
              for r in events.confidence_by_type_item(both).collect()}
    assert shares["flood", "boat"] == (0.75, 75.0)
    known = sorted({t for _, t in counts} - {"flood"})
    table = events.event_count_by_camera(rows)
    wide = {r.camera_id: r.asDict() for r in widen(table, "camera_id", "event_type", "events", known).collect()}
    assert all(wide[k][t] == n for (k, t), n in long_counts(table, "camera_id").items())
    with pytest.raises(Exception, match="event_type is not listed: flood"):
        widen(events.event_count_by_camera(both), "camera_id", "event_type", "events", known).collect()


def test_frequency_keeps_null_camera(rows, frame):
    expected = {}
    for camera in frame.camera_id:
        camera = None if pd.isna(camera) else int(camera)
        expected[camera] = expected.get(camera, 0) + 1
    ours = [(r.camera_id, r.events) for r in events.event_frequency_by_camera(rows).collect()]
    assert dict(ours) == expected and expected[None] == 1
    assert [n for _, n in ours] == sorted(expected.values(), reverse=True)


def test_count_by_lane_and_rollup(rows, frame):
    expected = {}
    for kind, zone, camera in zip(frame.event_type, frame.zone, frame.camera_id):
        if pd.notna(kind) and pd.notna(zone):
            expected[kind, zone] = expected.get((kind, zone), 0) + pd.notna(camera)
    ours = indexed(events.event_count_by_lane(rows), "event_type", "zone").events
    assert ours.to_dict() == expected
    rollup = events.event_lane_rollup(rows).toPandas()
    leaves = rollup[rollup.level == events.LEAF]
    types = rollup[rollup.level == events.EVENT_TYPE].set_index("event_type").events
    assert leaves.set_index(["event_type", "zone"]).events.to_dict() == expected
    assert types.to_dict() == leaves.groupby("event_type").events.sum().to_dict()
    assert rollup[rollup.level == events.TOTAL].events.tolist() == [leaves.events.sum()]


@pytest.mark.parametrize("view, operator", [
    ("b2t", events.lane_count_b2t), ("t2b", events.lane_count_t2b),
])
def test_lanes(rows, frame, view, operator):
    lanes = frame[[str(z).startswith(view) for z in frame.zone]]
    found = operator(rows)
    assert long_counts(found, "zone") == counted(lanes, "zone")
    order = [(r.zone, r.event_type) for r in found.collect()]
    assert order == sorted(sorted(order, key=lambda x: x[1]), key=lambda x: x[0], reverse=view == "b2t")


def test_confidence_by_type_and_item(rows, frame):
    cells = {}
    for kind, item, value in zip(frame.event_type, frame.item_type, frame.confidence):
        if pd.notna(kind) and pd.notna(item) and pd.notna(value):
            cells.setdefault((kind, item), []).append(value)
    ours = {(r.event_type, r.item_type): r for r in events.confidence_by_type_item(rows).collect()}
    assert set(ours) == set(cells)
    for cell, values in cells.items():
        mean = sum(values) / len(values)
        assert ours[cell].confidence == pytest.approx(mean)
        assert ours[cell].percent == pytest.approx(100 * mean, abs=0.00501)
