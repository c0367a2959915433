"""Registered queries against their SQL, and their plans."""

import re
import time

import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

import __spark_entry__ as registry
import oracle_queries
from compare import differences, duck
from lanescope import Slicer
from lanescope.operators import facts
from lanescope.sources import fixtures

# The queries of the llm subpackage have tests of their own.
QUERIES = registry._own_queries()
SQL = oracle_queries.oracle_sql()
# Iterated estimates; tests/test_model_choice.py restates them.
WITHOUT_SQL = {"los_model_arma", "los_backtest_arma", "los_forecast_arma", "los_scores_arma"}
# An observed LOS of 0 is divided by machine epsilon: last bits differ between engines.
LOOSE = {"los_scores", "los_scores_by_order"}


@pytest.fixture(scope="module")
def databases():
    return {folder: duck(folder) for folder in (SMALL, MEDIUM)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL
    assert set(QUERIES) <= set(registry.queries()) and set(SQL) <= set(registry.oracle_sql())


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, databases, name, folder):
    expected = databases[folder].execute(SQL[name]).df()
    ours = QUERIES[name](spark, folder).toPandas()
    if name in LOOSE and folder == SMALL:
        ours, expected = (x.sort_values("destination").reset_index(drop=True) for x in (ours, expected))
        assert ours.n_test.tolist() == expected.n_test.tolist()
        for column in ("mape", "rmse"):
            assert ours[column].tolist() == pytest.approx(expected[column].tolist(), rel=1e-5)
        return
    assert len(expected) > 0
    assert differences(ours, expected) is None


def test_entry(spark):
    result = registry.entry(spark)
    assert result.columns[0] == "datetime" and result.count() > 0


def scans(spark):
    """Input records of the finished stages, by stage."""
    gateway = spark.sparkContext._gateway
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    found, each = {}, stages.iterator()
    while each.hasNext():
        stage = each.next()
        if stage.status().toString() == "COMPLETE":
            found[stage.stageId()] = stage.inputRecords()
    return found


@pytest.mark.parametrize("name", [
    "event_facts", "volume_facts", "confidence_by_type", "hourly_confidence",
    "hourly_event_count_in", "los_heat_map_scale", "hourly_los", "los_backtest", "los_forecast",
    "los_scores", "los_backtest_by_order", "los_forecast_by_order",
])
def test_facts_are_read_once(spark, name):
    before = set(scans(spark))
    QUERIES[name](spark, MEDIUM).write.format("noop").mode("overwrite").save()
    time.sleep(0.5)
    large = [n for stage, n in scans(spark).items() if stage not in before and n > 5_000]
    table = "lineitem" if "los" in name or "volume" in name else "events"
    assert large == [spark.read.parquet(f"{MEDIUM}/{table}.parquet").count()]


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name, folder):
    query = QUERIES[name](spark, folder)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Every window is partitioned: its specification starts with a key, not with a sort order.
    for window in re.findall(r"windowspecdefinition\(([^,]+),", plan):
        assert " ASC" not in window and " DESC" not in window
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        static = QUERIES[name](spark, folder)
        code = static._jdf.queryExecution().explainString(modes.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert max(sizes, default=0) < 8000  # beyond it the JVM interprets the stage


def lake(spark, tmp_path):
    """Events and cameras as plain tables, as in production."""
    events, cameras = str(tmp_path / "events"), str(tmp_path / "cameras")
    fixtures.events(spark, SMALL).write.parquet(events)
    fixtures.cameras(spark, SMALL).write.parquet(cameras)
    return spark.read.parquet(events), spark.read.parquet(cameras)


def formatted(spark, table):
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    return table._jdf.queryExecution().explainString(modes.fromString("formatted"))


def test_span_and_direction_reach_the_scan_and_cameras_prune_before_the_shuffle(spark, tmp_path):
    events, cameras = lake(spark, tmp_path)
    result = facts.event_facts(events, cameras, registry.NARROW)
    text = formatted(spark, result)
    scans = re.findall(r"\n\(\d+\) Scan parquet.*?\n\n", text, re.S)
    facts_scan = next(scan for scan in scans if "description" in scan)
    pushed = re.search(r"PushedFilters: (.*)", facts_scan).group(1)
    assert "GreaterThanOrEqual(time,2024-01-01T00:00)" in pushed
    assert "LessThan(time,2024-01-03T01:00)" in pushed
    assert "direction,IN" in pushed or "direction, [IN]" in pushed
    others = [scan for scan in scans if "description" not in scan]
    assert others and all("latitude" not in scan and "address" in scan for scan in others)
    # Small cameras: the semi join sits below the aggregation and is a broadcast.
    tree = text.split("\n\n")[0]
    semi = re.search(r"BroadcastHashJoin LeftSemi", tree)
    assert semi and tree.count("HashAggregate", 0, semi.start()) >= 2
    assert "SortMergeJoin" not in tree
    # Fact rows are shuffled once.
    assert tree[: semi.start()].count("Exchange") - tree[: semi.start()].count("BroadcastExchange") == 1


def test_large_cameras_are_not_broadcast_and_hot_ones_are_split(spark, tmp_path):
    """One camera holds most groups; the shuffle join splits it and the result is the same."""
    events, cameras = lake(spark, tmp_path)
    hot = spark.range(0, 60_000, 1, 8).selectExpr(
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id % 24 AS INT)) AS time",
        "CASE WHEN id % 3 = 0 THEN id % 9 ELSE 0L END AS camera_id", "'IN' AS direction",
        "concat('b2t_', id) AS zone", "'accident' AS event_type", "concat('item', id) AS item_type",
        """'{"confidence":0.5}' AS description""",
    )
    hot.write.parquet(str(tmp_path / "hot"))
    hot = spark.read.parquet(str(tmp_path / "hot"))
    slicer = Slicer(registry.WIDE.roads, ["IN"])
    result = facts.event_facts(hot, cameras, slicer)
    expected = sorted(map(tuple, result.collect()))
    assert len(expected) > 40_000
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # So little data would be merged into one map task, and a split is by map tasks.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        shuffled = facts.event_facts(hot, cameras, slicer)
        rows = shuffled.collect()
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "skew=true" in plan
    assert sorted(map(tuple, rows)) == expected


def test_forecast_appends_future_hours_without_a_join(spark):
    volume_part = QUERIES["los_model_by_order"](spark, MEDIUM)
    query = QUERIES["los_forecast_by_order"](spark, MEDIUM)
    joins = [
        q._jdf.queryExecution().executedPlan().toString().count("Join")
        for q in (volume_part, query)
    ]
    # The facts' own joins appear once for the observed rows and once for the model.
    assert joins[1] <= 2 * joins[0]
    ahead = query.where("observed IS NULL")
    assert ahead.count() == registry.FORECAST_HOURS * 2


def test_series_grow_with_the_data(spark):
    few, many = (
        QUERIES["camera_los_model"](spark, folder).count() for folder in (SMALL, MEDIUM)
    )
    assert many > 4 * few and many >= 200


def test_volume_selection_prunes_columns(spark):
    total = QUERIES["mean_hourly_car_count"](spark, SMALL)
    plan = total._jdf.queryExecution().executedPlan().toString()
    # Speeds and zones' counts are not needed for the car count, and are not computed.
    assert "avg_speed" not in plan and "count(distinct" not in plan


def test_results_do_not_depend_on_partitioning(spark):
    name = "hourly_los"
    one = QUERIES[name](spark, SMALL).select("datetime", "destination", F.round("LOS", 9).alias("y"))
    rows = sorted(map(tuple, one.collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        two = QUERIES[name](spark, SMALL).select(
            "datetime", "destination", F.round("LOS", 9).alias("y")
        )
        assert sorted(map(tuple, two.collect()), key=str) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
