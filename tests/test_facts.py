import pytest
from conftest import SMALL, at
from pyspark.sql import functions as F

import __spark_entry__ as registry
from lanescope import Slicer
from lanescope.operators import facts
from lanescope.schema import EVENT_FACTS, VOLUME_FACTS
from lanescope.sources import fixtures

ALL = Slicer(["R", "S"], ["IN", "OUT"])
CAMERA = (1, "EQ", "R", 3.0, 101.0)


def event(time, camera=1, direction="IN", zone="b2t_1", kind="accident", item="car", conf="0.5"):
    text = None if conf is None else f'{{"confidence":{conf}}}'
    return (time, camera, direction, zone, kind, item, text)


def reading(zone, kind, count, speed, time=at(0), camera=1, destination="IN"):
    return (time, camera, destination, zone, kind, count, None if speed is None else float(speed))


def test_event_confidence_is_averaged_per_hour(events_of, cameras_of):
    rows = events_of(
        event(at(0, 5), conf="0.5"), event(at(0, 55), conf="0.8"), event(at(1), conf="0.9"),
        event(at(1), conf=None, kind="error"),
    )
    out = facts.event_facts(rows, cameras_of(CAMERA), ALL)
    assert out.columns == EVENT_FACTS
    found = {(r.datetime.hour, r.event_type): r.confidence for r in out.collect()}
    assert found == {(0, "accident"): 0.65, (1, "accident"): 0.9, (1, "error"): None}


def test_mean_confidence_has_eight_decimals(events_of, cameras_of):
    rows = events_of(*[event(at(0), conf=c) for c in ("0.1", "0.1", "0.2")])
    assert facts.event_facts(rows, cameras_of(CAMERA), ALL).first().confidence == 0.13333333


def test_camera_with_two_roads_gives_two_rows(events_of, cameras_of):
    cameras = cameras_of(CAMERA, (1, "EQ", "S", 3.0, 101.0))
    out = facts.event_facts(events_of(event(at(0))), cameras, ALL)
    assert sorted(r.address for r in out.collect()) == ["R", "S"]


def test_unmatched_events_and_cameras_give_no_row(events_of, cameras_of):
    rows = events_of(event(at(0), camera=9), event(at(0), camera=None))
    assert facts.event_facts(rows, cameras_of(CAMERA), ALL).count() == 0


@pytest.mark.parametrize("slicer", [Slicer([], ["IN"]), Slicer(["R"], [])])
def test_empty_selection_gives_no_row(events_of, volumes_of, cameras_of, slicer):
    cameras = cameras_of(CAMERA)
    assert facts.event_facts(events_of(event(at(0))), cameras, slicer).count() == 0
    rows = volumes_of(reading("b2t_1", "car", 1, 10))
    assert facts.volume_facts(rows, cameras, slicer).count() == 0


def test_null_directions_are_never_selected(events_of, cameras_of):
    rows = events_of(event(at(0), direction=None), event(at(0), direction="OUT"))
    assert facts.event_facts(rows, cameras_of(CAMERA), ALL).count() == 1


def test_null_zone_and_types_are_groups(events_of, cameras_of):
    rows = events_of(event(at(0), zone=None), event(at(0), zone=None), event(at(0), item=None))
    assert facts.event_facts(rows, cameras_of(CAMERA), ALL).count() == 2


def test_volume_measures(volumes_of, cameras_of):
    rows = volumes_of(
        reading("b2t_1", "ALL", 100, 40), reading("b2t_1", "motorbike", 10, 60),
        reading("b2t_2", "car", 30, 50), reading("b2t_3", "bus", 5, 25),
        reading("b2t_3", "car", 1, 0), reading("b2t_3", "car", 1, -10),
    )
    row = facts.volume_facts(rows, cameras_of(CAMERA), ALL).first()
    assert list(row.asDict()) == VOLUME_FACTS
    assert (row.bus_count, row.car_count, row.lorry_count, row.motorbike_count, row.total_count) == (
        5, 32, 0, 10, 100,
    )
    assert (row.lane_speed, row.motor_speed, row.indicator, row.POV) == (37.5, 60.0, 3, "b2t")
    assert row.LOS == (100 - 10) / (37.5 * 3)


@pytest.mark.parametrize("kind, speed, counted", [
    ("ALL", None, 1), ("ALL", -10, 0), ("motorbike", -10, 0), ("car", -10, 1), ("ALL", 0, 1),
])
def test_indicator(volumes_of, cameras_of, kind, speed, counted):
    row = facts.volume_facts(volumes_of(reading("b2t_1", kind, 1, speed)), cameras_of(CAMERA), ALL)
    assert row.first().indicator == counted


@pytest.mark.parametrize("rows", [
    [("ALL", 10, -10), ("car", 5, None)],  # no lane speed
    [("ALL", 10, -10)],  # indicator 0 and no lane speed
])
def test_los_is_null_without_a_divisor(volumes_of, cameras_of, rows):
    table = volumes_of(*[reading("b2t_1", *row) for row in rows])
    assert facts.volume_facts(table, cameras_of(CAMERA), ALL).first().LOS is None


def test_counts_grow_with_a_repeated_camera_row_and_means_do_not(volumes_of, cameras_of):
    rows = volumes_of(reading("b2t_1", "ALL", 9, 10), reading("b2t_1", "car", 4, 20))
    once = facts.volume_facts(rows, cameras_of(CAMERA), ALL).first()
    twice = facts.volume_facts(rows, cameras_of(CAMERA, CAMERA), ALL).collect()
    assert len(twice) == 1
    assert (twice[0].total_count, twice[0].car_count) == (18, 8)
    assert (twice[0].lane_speed, twice[0].indicator) == (once.lane_speed, once.indicator)


def test_null_counts_stay_null_only_if_nothing_else_matches(volumes_of, cameras_of):
    rows = volumes_of(reading("b2t_1", "car", None, 10))
    row = facts.volume_facts(rows, cameras_of(CAMERA), ALL).first()
    assert (row.car_count, row.bus_count) == (None, 0)


def test_aggregating_before_the_join_equals_joining_first(spark):
    """The plain formulation: join raw rows with camera rows, then group."""
    cameras = fixtures.cameras(spark, SMALL)
    cameras = cameras.union(cameras.where("camera_id < 4")).union(
        cameras.where("camera_id < 3").withColumn("address", F.lit("ASIA"))
    )
    events, volumes = fixtures.events(spark, SMALL), fixtures.volumes(spark, SMALL)
    for table in (cameras, events, volumes):
        table.createOrReplaceTempView({CAM: "cam", EV: "ev", VOL: "vol"}[kind_of(table)])
    plain_events = spark.sql("""
        SELECT CAST(date_trunc('HOUR', t.time) AS TIMESTAMP_NTZ) AS datetime, c.address, c.camera_id,
               t.direction, t.zone, t.event_type, t.item_type, count(*) AS n
        FROM ev t JOIN cam c ON t.camera_id = c.camera_id
        WHERE c.address IN ('ASIA', 'EUROPE', 'AFRICA') AND t.direction IN ('IN', 'OUT')
        GROUP BY ALL""")
    some = Slicer(registry.SOME_ROADS, ["IN", "OUT"])
    ours = facts.event_facts(events, cameras, some)
    keys = EVENT_FACTS[:-1]
    assert ours.select(keys).exceptAll(plain_events.select(keys)).count() == 0
    assert plain_events.select(keys).exceptAll(ours.select(keys)).count() == 0
    plain_volumes = spark.sql("""
        SELECT CAST(date_trunc('HOUR', t.time) AS TIMESTAMP_NTZ) AS datetime, c.address,
               c.equipment_id, c.camera_id, t.destination, left(t.zone, 3) AS POV,
               sum(CASE WHEN vehicle_type = 'car' THEN agg_count ELSE 0 END) AS car_count,
               sum(CASE WHEN vehicle_type = 'ALL' THEN agg_count ELSE 0 END) AS total_count,
               count(DISTINCT CASE WHEN avg_speed < 0 AND vehicle_type IN ('ALL', 'motorbike')
                              THEN NULL ELSE t.zone END) AS indicator
        FROM vol t JOIN cam c ON t.camera_id = c.camera_id
        WHERE c.address IN ('ASIA', 'EUROPE', 'AFRICA') AND t.destination IN ('IN', 'OUT')
        GROUP BY ALL""")
    ours = facts.volume_facts(volumes, cameras, some).select(plain_volumes.columns)
    assert ours.exceptAll(plain_volumes).count() == 0
    assert plain_volumes.exceptAll(ours).count() == 0


CAM, EV, VOL = "equipment_id", "event_type", "vehicle_type"


def kind_of(table):
    return next(kind for kind in (CAM, EV, VOL) if kind in table.columns)


def test_los_times_divisor_is_the_lane_vehicles(spark):
    rows = facts.volume_facts(
        fixtures.volumes(spark, SMALL), fixtures.cameras(spark, SMALL), registry.WIDE
    ).where("LOS IS NOT NULL")
    off = F.abs(
        F.col("LOS") * F.col("lane_speed") * F.col("indicator")
        - (F.col("total_count") - F.col("motorbike_count"))
    )
    assert rows.count() > 0
    assert rows.where(off > 1e-6).count() == 0


def test_row_order_does_not_matter(spark):
    events, cameras = fixtures.events(spark, SMALL), fixtures.cameras(spark, SMALL)
    there = facts.event_facts(events, cameras, registry.WIDE)
    back = facts.event_facts(
        events.orderBy(F.rand(7)).repartition(5), cameras.orderBy(F.rand(3)), registry.WIDE
    )
    assert there.exceptAll(back).count() == 0 and back.exceptAll(there).count() == 0


def test_camera_selections(cameras_of):
    cameras = cameras_of((1, "E", "R", 1.0, 2.0), (2, "E", "S", 1.0, 2.0), (3, "E", None, 1.0, 2.0))
    assert [r.camera_id for r in facts.cameras_on_roads(cameras, ["S"]).collect()] == [2]
    assert facts.cameras_on_roads(cameras, []).count() == 0
    assert sorted(r.camera_id for r in facts.cameras_by_id(cameras, [1, 3]).collect()) == [1, 3]


def test_newest_first(volumes_of, cameras_of):
    rows = volumes_of(*[reading("b2t_1", "car", 1, 10, time=at(h)) for h in (3, 9, 1)])
    out = facts.newest_first(facts.volume_facts(rows, cameras_of(CAMERA), ALL)).collect()
    assert [r.datetime.hour for r in out] == [9, 3, 1]
