import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from conftest import MEDIUM, SMALL, at
from pyspark.sql import functions as F

import __spark_entry__ as registry
from lanescope import Slicer, plans, sources
from lanescope.operators import facts
from lanescope.schema import CAMERAS, EVENTS, VOLUMES
from lanescope.sources import fixtures


@pytest.mark.parametrize("source, schema", [
    (fixtures.cameras, CAMERAS), (fixtures.events, EVENTS), (fixtures.volumes, VOLUMES),
])
def test_fixture_schema(spark, source, schema):
    found = source(spark, SMALL)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schema]


def test_fixtures_keep_every_row(spark):
    for source, table in (
        (fixtures.cameras, "supplier"), (fixtures.events, "events"), (fixtures.volumes, "lineitem"),
    ):
        raw = spark.read.parquet(f"{MEDIUM}/{table}.parquet").count()
        assert source(spark, MEDIUM).count() == raw


def test_event_facts_survive_csv(spark, tmp_path):
    rows = facts.newest_first(facts.event_facts(
        fixtures.events(spark, SMALL), fixtures.cameras(spark, SMALL), registry.WIDE
    ))
    path = str(tmp_path / "facts")
    sources.write_csv(rows, path)
    back = sources.read_table(spark, rows.schema, path, "csv", timestampNTZFormat="yyyy-MM-dd HH:mm:ss")
    assert back.columns == rows.columns
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    first = next(p for p in (tmp_path / "facts").glob("part-*.csv")).read_text("utf-8")
    assert first.splitlines()[0] == ",".join(rows.columns)
    assert ":00:00," in first.splitlines()[1]


def test_csv_source_uses_the_declared_schema(spark, tmp_path):
    (tmp_path / "cameras.csv").write_text(
        "camera_id,equipment_id,address,latitude,longitude\n7,E,Jalan Ampang é,3.1,\n", "utf-8"
    )
    row = sources.read_table(spark, CAMERAS, str(tmp_path / "cameras.csv"), "csv").first()
    assert row.asDict() == {
        "camera_id": 7, "equipment_id": "E", "address": "Jalan Ampang é", "latitude": 3.1,
        "longitude": None,
    }


def test_untyped_numbers_are_coerced_and_bad_ones_become_null(spark):
    text = spark.createDataFrame(
        [("2024-01-01 05:00:00", "1", "IN", "b2t_1", "car", "12", "30.5"),
         ("2024-01-01 05:00:00", "x", "IN", "b2t_1", "car", "many", "")],
        "time STRING, camera_id STRING, destination STRING, zone STRING, vehicle_type STRING, "
        "agg_count STRING, avg_speed STRING",
    )
    good, bad = sources.conform(text, VOLUMES).collect()
    assert (good.time, good.camera_id, good.agg_count, good.avg_speed) == (at(5), 1, 12, 30.5)
    assert (bad.camera_id, bad.agg_count, bad.avg_speed) == (None, None, None)


def test_important_roads(spark, tmp_path):
    for name, roads in (("hot", ["A", "B"]), ("inout", ["C"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["road", *roads]), "utf-8")
    hot, inout = sources.read_important_roads(spark, str(tmp_path / "hot.csv"), str(tmp_path / "inout.csv"))
    assert sorted(r.road for r in hot.collect()) == ["A", "B"]
    assert [r.road for r in inout.collect()] == ["C"]


def test_jdbc_options():
    options = sources.jdbc_options(
        "jdbc:mysql://host/db", "t", "time", "2024-01-01", "2024-02-01", partitions=8, user="u"
    )
    assert options["partitionColumn"] == "time" and options["numPartitions"] == "8"
    assert options["preferTimestampNTZ"] == "true" and options["user"] == "u"
    assert "partitionColumn" not in sources.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        sources.jdbc_options("jdbc:x", "t", "time")


def test_lake_by_day_is_pruned_and_gives_the_same_facts(spark, tmp_path):
    lake = str(tmp_path / "lake")
    sources.write_by_day(fixtures.events(spark, SMALL), lake)
    cameras = fixtures.cameras(spark, SMALL)
    slicer = Slicer(registry.WIDE.roads, ["IN", "OUT"], at(20, day=3), at(4, day=5))
    table = sources.read_table(spark, EVENTS, lake, day_column="day")
    ours = facts.event_facts(table, cameras, replace(slicer, day_column="day"))
    plain = facts.event_facts(fixtures.events(spark, SMALL), cameras, slicer)
    assert plain.count() > 0
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_one_more_day_leaves_the_others(spark, tmp_path):
    lake = str(tmp_path / "lake")
    days = [spark.createDataFrame([(at(3, day=d), 1, "IN", "b2t_1", "error", "car", None)], EVENTS) for d in (1, 2)]
    sources.write_by_day(days[0], lake)
    sources.write_by_day(days[1], lake)
    sources.write_by_day(days[1].union(days[1]), lake)
    counts = spark.read.parquet(lake).groupBy("day").count().collect()
    assert sorted((r.day.day, r["count"]) for r in counts) == [(1, 1), (2, 2)]


def test_a_foreign_day_column_is_no_filter(spark):
    data = [(at(3), 1, "IN", "b2t_1", "error", "car", None)]
    cameras = spark.createDataFrame([(1, "EQ", "R", 1.0, 2.0)], CAMERAS)
    table = spark.createDataFrame(data, EVENTS).withColumn("day", F.lit("1999-01-01").cast("date"))
    slicer = Slicer(["R"], ["IN"], at(0), at(5))
    assert facts.event_facts(table, cameras, slicer).count() == 1


def test_dashboards_and_exports(spark, tmp_path):
    cameras = fixtures.cameras(spark, SMALL)
    scratch = str(tmp_path / "scratch")
    board = plans.event_dashboard(fixtures.events(spark, SMALL), cameras, registry.WIDE, scratch)
    for name, result in board.items():
        if name == "cameras_on_roads":
            continue  # the registered query selects fewer roads
        query = registry.queries()[name](spark, SMALL)
        assert set(result.columns) == set(query.columns), name
        assert result.count() == query.count(), name
    traffic = plans.volume_dashboard(fixtures.volumes(spark, SMALL), cameras, registry.WIDE)
    for name, result in traffic.items():
        if name == "cameras_on_roads":
            continue
        query = registry.queries()[name](spark, SMALL)
        assert result.columns == query.columns, name
        assert result.count() == query.count(), name
    outlook = plans.forecast_dashboard(traffic["hourly_los"], days=2)
    assert outlook["los_forecast"].where("observed IS NULL").count() == 2 * 48
    assert outlook["los_scores"].count() == 2
    paths = plans.export({**board, **traffic}, str(tmp_path / "out"))
    assert [path.rsplit("/", 1)[1] for path in paths] == [
        "event_raw_data.csv", "event_count_by_camera_id.csv", "event_count_by_zone_lane.csv",
        "volume_speed_los.csv",
    ]
    lanes = spark.read.option("header", True).csv(paths[2])
    assert lanes.count() == board["event_count_by_lane"].count()
    # The facts were computed once: later results read them, and only the columns they need.
    files = board["confidence_by_type"].inputFiles()
    assert files and all(scratch in file for file in files)
    plan = board["confidence_by_type"]._jdf.queryExecution().executedPlan().toString()
    assert "address" not in plan.split("ReadSchema")[1]


def test_the_shared_folder_without_a_setting(spark, monkeypatch):
    from lanescope import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf()

    Session.conf.update({"spark.checkpoint.dir": "hdfs://lake/scratch/", "spark.master": "yarn"})
    assert session.shared_root(Session) == "hdfs://lake/scratch"
    for master in ("yarn", "spark://host:1", "local-cluster[2,1,512]"):
        Session.conf = Conf({"spark.master": master})
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_root(Session)
    Session.conf = Conf({"spark.master": "local[4]"})
    root = session.shared_root(Session)
    assert root.startswith("file://") and root == session.shared_root(Session)


def test_a_session_without_defaults_settles_tables(tmp_path):
    """Another process whose Spark has no configuration folder."""
    code = (
        "from lanescope import plans; from lanescope.session import local_session; "
        "from lanescope.plans.dashboards import settle; "
        "s = local_session(2, '1g'); print(settle(s.range(7)).count())"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("7"), done.stderr[-2000:]
