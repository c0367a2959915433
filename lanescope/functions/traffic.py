"""Volume, speed and level-of-service expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanescope.schema import LOS_THRESHOLDS

NOT_A_LANE = ("ALL", "motorbike")


def point_of_view(zone: Column) -> Column:
    return F.left(zone, F.lit(3))


def vehicles(kind: str) -> Column:
    """Vehicles of one kind; 0 where a group has none."""
    return F.sum(F.when(F.col("vehicle_type") == kind, F.col("agg_count")).otherwise(0))


def lane_measured() -> Column:
    return (F.col("avg_speed") > 0) & ~F.col("vehicle_type").isin(*NOT_A_LANE)


def motor_measured() -> Column:
    return (F.col("avg_speed") > 0) & (F.col("vehicle_type") == "motorbike")


def lane_speed() -> Column:
    """Mean measured speed of lane vehicles, every row with the same weight."""
    return F.avg(F.when(lane_measured(), F.col("avg_speed")))


def motor_speed() -> Column:
    return F.avg(F.when(motor_measured(), F.col("avg_speed")))


def measured_zone() -> Column:
    """The zone, but NULL for a total or motorbike row without a measured speed.

    A NULL speed does not make the condition true, so that row's zone counts.
    """
    unmeasured = (F.col("avg_speed") < 0) & F.col("vehicle_type").isin(*NOT_A_LANE)
    return F.when(unmeasured, F.lit(None)).otherwise(F.col("zone"))


def level_of_service() -> Column:
    """Lane vehicles per speed and zone; NULL if a factor is missing or the divisor is 0."""
    return F.try_divide(
        (F.col("total_count") - F.col("motorbike_count")).cast("double"),
        F.col("lane_speed") * F.col("indicator"),
    )


def los_band(los: Column) -> Column:
    """Number of thresholds reached, 0 to 6."""
    reached = sum((los >= bound).cast("int") for bound, _ in LOS_THRESHOLDS)
    return reached.cast("int")
