"""Fact tables from partial sums that merge exactly.

A state row holds sums, counts and the set of measured zones of one fact group, before any camera,
road or direction is selected.  States of disjoint rows merge by adding sums and uniting sets, so that
late rows cost their own aggregation and not that of the rows already seen.  Cameras are joined when
facts are made: another selection, or a camera that moved, needs no raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions import (
    confidence_number,
    confidence_of,
    hour_of,
    measured_zone,
    point_of_view,
    vehicles,
)
from lanescope.functions.traffic import lane_measured, motor_measured
from lanescope.operators.facts import event_facts_of, volume_facts_of
from lanescope.schema import COUNTED_VEHICLES, EVENT_KEYS, VOLUME_KEYS
from lanescope.slicer import Slicer

#: A sum of decimal(5,4) numbers, as Spark types it; sums of sums are brought back to it.
CONFIDENCE_SUM = "decimal(15,4)"
SPEEDS = {"lane": lane_measured, "motor": motor_measured}


def event_state(events: DataFrame) -> DataFrame:
    """EVENT_KEYS with the sum and number of confidences; rows without a time are in no hour."""
    return (
        events.where(F.col("time").isNotNull())
        .withColumns({
            "datetime": hour_of(F.col("time")),
            "_number": confidence_number(F.col("event_type"), F.col("description")),
        })
        .withColumn("_confidence", confidence_of(F.col("_number")))
        .groupBy(*EVENT_KEYS)
        .agg(
            F.sum("_confidence").cast(CONFIDENCE_SUM).alias("confidence_sum"),
            F.count("_confidence").alias("confidence_n"),
        )
    )


def volume_state(volumes: DataFrame) -> DataFrame:
    """VOLUME_KEYS with vehicle counts, sums and numbers of measured speeds, and measured zones."""
    speeds = [
        column
        for kind, measured in SPEEDS.items()
        for column in (
            F.sum(F.when(measured(), F.col("avg_speed"))).alias(f"{kind}_sum"),
            F.count(F.when(measured(), F.col("avg_speed"))).alias(f"{kind}_n"),
        )
    ]
    return (
        volumes.where(F.col("time").isNotNull())
        .withColumn("datetime", hour_of(F.col("time")))
        .withColumn("POV", point_of_view(F.col("zone")))
        .groupBy(*VOLUME_KEYS)
        .agg(
            *[vehicles(kind).cast("bigint").alias(name) for kind, name in COUNTED_VEHICLES.items()],
            *speeds,
            F.sort_array(F.collect_set(measured_zone())).alias("zones"),
        )
    )


def merged(*states: DataFrame) -> DataFrame:
    """One state of rows that no two of ``states`` have in common."""
    every = reduce(DataFrame.unionByName, states)
    keys = EVENT_KEYS if "confidence_n" in every.columns else VOLUME_KEYS
    own = [name for name in every.columns if name in keys or name == "day"]
    added = [
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
        if name == "zones" else F.sum(name).cast(every.schema[name].dataType).alias(name)
        for name in every.columns if name not in own
    ]
    return every.groupBy(*own).agg(*added).select(*every.columns)


def _selected(state: DataFrame, slicer: Slicer, direction: str) -> DataFrame:
    """The hours and directions of the selection; the range reaches the reader of a stored state."""
    hours = slicer.in_span(state.withColumnRenamed("datetime", "time"))
    return hours.withColumnRenamed("time", "datetime").where(slicer.in_direction(direction))


def event_facts_from(state: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """What ``facts.event_facts`` gives for the rows behind ``state``."""
    n = F.col("confidence_n").cast("decimal(20,0)")
    mean = F.try_divide(F.col("confidence_sum"), n).cast("decimal(9,8)")
    groups = _selected(state, slicer, "direction").withColumn("mean", mean)
    return event_facts_of(groups, cameras, slicer)


def volume_facts_from(state: DataFrame, cameras: DataFrame, slicer: Slicer) -> DataFrame:
    """What ``facts.volume_facts`` gives for the rows behind ``state``."""
    groups = _selected(state, slicer, "destination").withColumns({
        **{f"{kind}_speed": F.try_divide(F.col(f"{kind}_sum"), F.col(f"{kind}_n")) for kind in SPEEDS},
        "indicator": F.size("zones").cast("bigint"),
    })
    return volume_facts_of(groups, cameras, slicer)
