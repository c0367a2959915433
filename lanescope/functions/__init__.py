from lanescope.functions.confidence import (
    confidence_number,
    confidence_of,
    detection_confidence,
)
from lanescope.functions.crosstab import complete_counts, widen
from lanescope.functions.hours import hour_label, hour_of, hour_text, hours_between
from lanescope.functions.keys import present
from lanescope.functions.traffic import (
    lane_speed,
    level_of_service,
    los_band,
    measured_zone,
    motor_speed,
    point_of_view,
    vehicles,
)

__all__ = [
    "complete_counts", "confidence_number", "confidence_of", "detection_confidence", "hour_label",
    "hour_of", "hour_text", "hours_between", "lane_speed", "level_of_service", "los_band",
    "measured_zone", "motor_speed", "point_of_view", "present", "vehicles", "widen",
]
