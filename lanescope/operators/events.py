"""Counts and confidence over the event facts.

Every count is a count of fact rows, not of raw detections. Groups with a NULL key are left out,
but for the camera frequency, which keeps cameras without an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions import complete_counts, present

LEAF, EVENT_TYPE, TOTAL = 0, 1, 2  # levels of the lane rollup


def event_total(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("events"))


def event_count_by_type(facts: DataFrame) -> DataFrame:
    return (
        present(facts, "event_type")
        .groupBy("event_type")
        .agg(F.count("camera_id").alias("events"))
    )


def confidence_by_type(facts: DataFrame) -> DataFrame:
    """Mean confidence of each event type that has one, and the same in percent."""
    return (
        present(facts, "event_type")
        .groupBy("event_type")
        .agg(F.avg("confidence").alias("confidence"))
        .where(F.col("confidence").isNotNull())
        .withColumn("percent", F.bround(F.col("confidence") * 100, 2))
    )


def event_count_by_camera(facts: DataFrame) -> DataFrame:
    """Every camera with every event type that occurs, 0 where it has none."""
    return complete_counts(present(facts, "camera_id", "event_type"), "camera_id", "event_type")


def event_frequency_by_camera(facts: DataFrame) -> DataFrame:
    """Events per camera, the most frequent first, cameras without an id together."""
    frequency = facts.groupBy("camera_id").agg(F.count("*").alias("events"))
    return frequency.orderBy(F.desc("events"), "camera_id")


def event_count_by_lane(facts: DataFrame) -> DataFrame:
    return (
        present(facts, "event_type", "zone")
        .groupBy("event_type", "zone")
        .agg(F.count("camera_id").alias("events"))
    )


def event_lane_rollup(facts: DataFrame) -> DataFrame:
    """Lane counts, their sum per event type and the grand total.

    The rollup runs over the lane counts, so its row expansion does not touch the facts.
    """
    return (
        event_count_by_lane(facts)
        .rollup("event_type", "zone")
        .agg(
            F.sum("events").alias("events"),
            (F.grouping("event_type") + F.grouping("zone")).cast("int").alias("level"),
        )
    )


def _lanes(facts: DataFrame, point_of_view: str) -> DataFrame:
    lanes = present(facts, "zone", "event_type").where(F.col("zone").startswith(point_of_view))
    return complete_counts(lanes, "zone", "event_type")


def lane_count_b2t(facts: DataFrame) -> DataFrame:
    """Every lane seen from bottom to top with every event type that occurs on such lanes."""
    return _lanes(facts, "b2t").orderBy(F.desc("zone"), "event_type")


def lane_count_t2b(facts: DataFrame) -> DataFrame:
    return _lanes(facts, "t2b").orderBy("zone", "event_type")


def confidence_by_type_item(facts: DataFrame) -> DataFrame:
    """Mean confidence of each event type and item type that has one, and the same in percent.

    What has none is dropped after the aggregation: a filter on the facts' mean would keep the
    camera filter of the facts from reaching the scan.
    """
    return (
        present(facts, "event_type", "item_type")
        .groupBy("event_type", "item_type")
        .agg(F.avg("confidence").alias("confidence"))
        .where(F.col("confidence").isNotNull())
        .withColumn("percent", F.bround(F.col("confidence") * 100, 2))
    )
