"""Metrics, heat map and hourly totals over the volume facts.

Means here are means of fact rows, each with the same weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions import los_band, present
from lanescope.operators.median import bracket_of, median_within
from lanescope.schema import COUNTED_VEHICLES, LOS_THRESHOLDS


def volume_speed_metrics(facts: DataFrame) -> DataFrame:
    """Least, mean and greatest car count, lane speed and LOS per destination."""
    measures = {
        "car_count": lambda column: column.cast("bigint"),
        "lane_speed": lambda column: F.bround(column, 2),
        "LOS": lambda column: F.bround(column, 4),
    }
    return present(facts, "destination").groupBy("destination").agg(*[
        shown(how(measure)).alias(f"{prefix}_{measure}")
        for measure, shown in measures.items()
        for prefix, how in (("min", F.min), ("mean", F.avg), ("max", F.max))
    ])


def los_heat_map(facts: DataFrame, cameras: DataFrame) -> DataFrame:
    """Mean LOS per destination and camera with a known place.

    Facts are averaged per camera before the cameras are joined. Listing a camera twice repeats
    all its rows alike, so the mean does not change, and each of its places gets it.
    """
    means = (
        present(facts, "destination", "camera_id")
        .groupBy("destination", "camera_id")
        .agg(F.avg("LOS").alias("LOS"))
        .where(F.col("LOS").isNotNull())
    )
    places = present(
        cameras.select("camera_id", "latitude", "longitude"), "latitude", "longitude"
    ).distinct()
    return means.join(places, "camera_id").select(
        "destination", "camera_id", "latitude", "longitude", "LOS"
    )


def los_heat_map_scale(heat_map: DataFrame) -> DataFrame:
    """Map centre and the least, median and greatest LOS over the cameras of a destination."""
    scale = heat_map.groupBy("destination").agg(
        F.avg("latitude").alias("center_latitude"),
        F.avg("longitude").alias("center_longitude"),
        F.min("LOS").alias("min_LOS"),
        F.max("LOS").alias("max_LOS"),
        *bracket_of("LOS"),
    )
    return median_within(heat_map, scale, ["destination"], "LOS", "median_LOS")


def hourly_vehicle_count(facts: DataFrame) -> DataFrame:
    """Vehicles of each kind per observed hour, all cameras together."""
    return (
        facts.groupBy("datetime")
        .agg(*[
            F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name.removesuffix("_count"))
            for name in COUNTED_VEHICLES.values()
        ])
    )


def mean_hourly_car_count(facts: DataFrame) -> DataFrame:
    return hourly_vehicle_count(facts).agg(F.avg("car").alias("mean_car"))


def los_thresholds(hourly_los: DataFrame) -> DataFrame:
    """The six thresholds with their colours, and how many hours of each destination reach them."""
    reached = hourly_los.groupBy("destination").agg(*[
        F.count_if(F.col("LOS") >= bound).alias(f"level_{level}")
        for level, (bound, _) in enumerate(LOS_THRESHOLDS, 1)
    ])
    lines = F.explode(F.array(*[
        F.struct(
            F.lit(level).alias("level"), F.lit(bound).alias("threshold"),
            F.lit(colour).alias("colour"), F.col(f"level_{level}").alias("hours"),
        )
        for level, (bound, colour) in enumerate(LOS_THRESHOLDS, 1)
    ]))
    return reached.select("destination", lines.alias("line")).select("destination", "line.*")


def hourly_los_band(hourly_los: DataFrame) -> DataFrame:
    """Band of each hour: the number of thresholds its LOS reaches, NULL without a LOS."""
    return hourly_los.select("datetime", "destination", "LOS", los_band(F.col("LOS")).alias("band"))
