"""Table schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

CAMERAS = StructType([
    StructField("camera_id", LongType()),
    StructField("equipment_id", StringType()),
    StructField("address", StringType()),  # the road the camera stands on
    StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
])

EVENTS = StructType([
    StructField("time", TimestampNTZType()),
    StructField("camera_id", LongType()),
    StructField("direction", StringType()),  # IN or OUT
    StructField("zone", StringType()),  # lane label, b2t... or t2b...
    StructField("event_type", StringType()),
    StructField("item_type", StringType()),
    StructField("description", StringType()),  # JSON-like text holding the confidence
])

VOLUMES = StructType([
    StructField("time", TimestampNTZType()),
    StructField("camera_id", LongType()),
    StructField("destination", StringType()),  # IN or OUT
    StructField("zone", StringType()),  # its first three characters are the point of view
    StructField("vehicle_type", StringType()),
    StructField("agg_count", IntegerType()),
    StructField("avg_speed", DoubleType()),  # negative: nothing measured
])

ROADS = StructType([StructField("road", StringType())])

EVENT_KEYS = ["datetime", "camera_id", "direction", "zone", "event_type", "item_type"]
VOLUME_KEYS = ["datetime", "camera_id", "destination", "POV"]

EVENT_FACTS = [
    "datetime", "address", "camera_id", "direction", "zone", "event_type", "item_type",
    "confidence",
]

# They must equal the source system's for right results.
COUNTED_VEHICLES = {
    "bus": "bus_count",
    "car": "car_count",
    "lorry": "lorry_count",
    "truck": "truck_count",
    "van": "van_count",
    "motorbike": "motorbike_count",
    "ALL": "total_count",
}
CONFIDENCE_FIELD = {
    "person_on_lane": '"conf":',
    "illegal_stop": '"confidence":',
    "accident": '"confidence":',
}
LOS_THRESHOLDS = [
    (24.36, "#00901a"),
    (39.94, "#6db046"),
    (57.73, "#a38600"),
    (77.72, "#d9d61c"),
    (100.0, "#e66c37"),
    (125.0, "#ff0000"),
]
TEST_SHARE = 0.3
NORMAL_90 = 1.6448536269514722  # two-sided 90 % quantile of the normal distribution
KPSS_5 = 0.463  # level of the stationarity statistic exceeded by chance in 5 of 100 series
MAPE_FLOOR = 2.220446049250313e-16
LOCAL_ZONE = "Asia/Kuala_Lumpur"
DEFAULT_WINDOW_DAYS = 2

VOLUME_FACTS = [
    "datetime", "address", "equipment_id", "camera_id", "destination", "POV",
    *COUNTED_VEHICLES.values(), "lane_speed", "motor_speed", "indicator", "LOS",
]


def collated(
    schema: StructType, collation: str = "UTF8_LCASE", plain: tuple[str, ...] = ("description",)
) -> StructType:
    """The schema with text that compares by ``collation``, as a source database may do.

    Columns ``plain`` are parsed, not compared, and stay as they are.  Selections, joins and groups over tables read with it then take texts as equal that the source
    takes as equal; the values stay as they are.  Spark pushes no filter on such a column into a
    file reader, as files know equality by bytes only: time ranges and days still are.
    """
    return StructType([
        StructField(f.name, StringType(collation), f.nullable)
        if isinstance(f.dataType, StringType) and f.name not in plain else f
        for f in schema
    ])
