"""Cameras on roads, and the two hourly fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions import (
    confidence_number,
    confidence_of,
    hour_of,
    lane_speed,
    level_of_service,
    measured_zone,
    motor_speed,
    point_of_view,
    vehicles,
)
from lanescope.schema import COUNTED_VEHICLES, EVENT_FACTS, EVENT_KEYS, VOLUME_FACTS, VOLUME_KEYS
from lanescope.slicer import Slicer


def cameras_on_roads(cameras: DataFrame, roads: Sequence[str]) -> DataFrame:
    return cameras.where(F.col("address").isin(*roads))


def cameras_by_id(cameras: DataFrame, camera_ids: Sequence[int]) -> DataFrame:
    return cameras.where(F.col("camera_id").isin(*camera_ids))


def _join_cameras(groups: DataFrame, cameras: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join aggregated facts to cameras; ``listings`` says how often a camera row repeats.

    Facts are aggregated before this join, so a camera holding a large share of the raw rows
    arrives as a few rows per hour. The semi join is there for the optimizer: it moves below the
    aggregation, and so drops other roads' raw rows before the shuffle, exactly when the cameras
    are small enough to broadcast. Otherwise it stays here and shuffles the groups only.
    """
    listed = cameras.groupBy("camera_id", *columns).agg(F.count("*").alias("listings"))
    return groups.join(cameras.select("camera_id"), "camera_id", "left_semi").join(
        listed, "camera_id"
    )


def event_facts(events: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """Mean detection confidence per hour, road, camera, direction, zone, event and item type."""
    groups = (
        slicer.in_span(events)
        .where(slicer.in_direction("direction"))
        .withColumns({
            "datetime": hour_of(F.col("time")),
            "_number": confidence_number(F.col("event_type"), F.col("description")),
        })
        .groupBy(*EVENT_KEYS)
        .agg(F.avg(confidence_of(F.col("_number"))).alias("mean"))
    )
    return event_facts_of(groups, cameras, slicer)


def event_facts_of(groups: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """Event facts of aggregated groups, which hold EVENT_KEYS and ``mean``."""
    # A camera listed twice on one road repeats every detection alike and leaves the mean as it is.
    facts = _join_cameras(groups, cameras_on_roads(cameras, slicer.roads), ["address"])
    return facts.withColumn("confidence", F.col("mean").cast("double")).select(*EVENT_FACTS)


def volume_facts(volumes: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """Vehicle counts, speeds, zones and level of service per hour, camera, destination and POV."""
    groups = (
        slicer.in_span(volumes)
        .where(slicer.in_direction("destination"))
        .withColumn("datetime", hour_of(F.col("time")))
        .withColumn("POV", point_of_view(F.col("zone")))
        .groupBy(*VOLUME_KEYS)
        .agg(
            *[vehicles(kind).alias(name) for kind, name in COUNTED_VEHICLES.items()],
            lane_speed().alias("lane_speed"),
            motor_speed().alias("motor_speed"),
            F.count_distinct(measured_zone()).alias("indicator"),
        )
    )
    return volume_facts_of(groups, cameras, slicer)


def volume_facts_of(groups: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """Volume facts of aggregated groups: VOLUME_KEYS, counts, mean speeds and ``indicator``."""
    facts = _join_cameras(
        groups, cameras_on_roads(cameras, slicer.roads), ["address", "equipment_id"]
    )
    # A camera listed twice repeats every row: counts grow with it, means and zones do not.
    counts = {
        name: (F.col(name) * F.col("listings")).cast("bigint")
        for name in COUNTED_VEHICLES.values()
    }
    return facts.withColumns(counts).withColumn("LOS", level_of_service()).select(*VOLUME_FACTS)


def newest_first(facts: DataFrame) -> DataFrame:
    """Facts by hour, latest first; apply it last, right before an export.

    The other keys break ties, so that one heavy hour can be sorted by several tasks.
    """
    ties = [c for c in ("camera_id", "address", *EVENT_KEYS, *VOLUME_KEYS) if c in facts.columns]
    ties = [c for c in dict.fromkeys(ties) if c != "datetime"]
    return facts.orderBy(F.desc("datetime"), *ties)
