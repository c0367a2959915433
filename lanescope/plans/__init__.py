from lanescope.plans.dashboards import (
    event_dashboard,
    export,
    forecast_dashboard,
    settle,
    volume_dashboard,
)
from lanescope.plans.fact_lake import add_to_state, read_state, replace_days

__all__ = [
    "add_to_state", "event_dashboard", "export", "forecast_dashboard", "read_state", "replace_days",
    "settle", "volume_dashboard",
]
