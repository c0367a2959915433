"""The three analyses as a whole: facts once, then every result over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lanescope.operators import autoregression, events, facts, forecast, hourly, volume
from lanescope.session import settle
from lanescope.slicer import Slicer
from lanescope.sources.export import write_csv

Results = dict[str, DataFrame]

# The file names of the exports.
EXPORTS = {
    "event_facts": "event_raw_data.csv",
    "event_count_by_camera": "event_count_by_camera_id.csv",
    "event_count_by_lane": "event_count_by_zone_lane.csv",
    "volume_facts": "volume_speed_los.csv",
}


def event_dashboard(
    detections: DataFrame, cameras: DataFrame, slicer: Slicer, scratch: str | None = None
) -> Results:
    """All event results of one selection. The facts are computed here, the rest when read."""
    rows = settle(facts.event_facts(detections, cameras, slicer), scratch)
    hourly_counts = {
        f"hourly_event_count_{direction.lower()}": hourly.hourly_event_count(rows, direction)
        for direction in slicer.directions
    }
    return {
        "cameras_on_roads": facts.cameras_on_roads(cameras, slicer.roads),
        "event_facts": facts.newest_first(rows),
        "event_total": events.event_total(rows),
        "event_count_by_type": events.event_count_by_type(rows),
        "confidence_by_type": events.confidence_by_type(rows),
        "event_count_by_camera": events.event_count_by_camera(rows),
        "event_frequency_by_camera": events.event_frequency_by_camera(rows),
        "event_count_by_lane": events.event_count_by_lane(rows),
        "event_lane_rollup": events.event_lane_rollup(rows),
        "lane_count_b2t": events.lane_count_b2t(rows),
        "lane_count_t2b": events.lane_count_t2b(rows),
        "confidence_by_type_item": events.confidence_by_type_item(rows),
        "hourly_confidence": hourly.hourly_confidence(rows),
        **hourly_counts,
    }


def volume_dashboard(
    readings: DataFrame, cameras: DataFrame, slicer: Slicer, scratch: str | None = None
) -> Results:
    """All volume, speed and LOS results of one selection."""
    rows = settle(facts.volume_facts(readings, cameras, slicer), scratch)
    on_roads = facts.cameras_on_roads(cameras, slicer.roads)
    heat_map = volume.los_heat_map(rows, on_roads)
    los = hourly.hourly_los(rows)
    return {
        "cameras_on_roads": on_roads,
        "volume_facts": facts.newest_first(rows),
        "volume_speed_metrics": volume.volume_speed_metrics(rows),
        "los_heat_map": heat_map,
        "los_heat_map_scale": volume.los_heat_map_scale(heat_map),
        "hourly_vehicle_count": volume.hourly_vehicle_count(rows),
        "mean_hourly_car_count": volume.mean_hourly_car_count(rows),
        "hourly_los": los,
        "los_thresholds": volume.los_thresholds(los),
        "hourly_los_band": volume.hourly_los_band(los),
    }


def forecast_dashboard(
    hourly_los: DataFrame, keys: Sequence[str] = ("destination",), days: int = 1,
    max_p: int = autoregression.MAX_P, d: int = 0, scratch: str | None = None,
) -> Results:
    """Split, model, backtest, scores and a forecast of ``days`` days for every series."""
    if days < 1:
        raise ValueError("days is at least 1")
    split = settle(forecast.split_series(hourly_los, keys), scratch)
    model = settle(autoregression.fit_ar(split, keys, max_p, d), scratch)
    backtest = autoregression.backtest_ar(split, model, keys)
    return {
        "los_split": split,
        "los_model": model,
        "los_backtest": backtest,
        "los_scores": forecast.score(backtest, keys),
        "los_forecast": autoregression.forecast_ar(split, model, keys, days * 24),
    }


def export(results: Results, folder: str) -> list[str]:
    """Write the exports among ``results`` as CSV below ``folder``; returns their paths."""
    paths = []
    for name, file in EXPORTS.items():
        if name in results:
            paths.append(f"{folder}/{file}")
            write_csv(results[name], paths[-1])
    return paths
