"""Hour arithmetic on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of(time: Column) -> Column:
    """The whole hour, still ``timestamp_ntz`` and untouched by the session zone.

    ``date_trunc`` would pass through the session zone and move hours that a daylight-saving
    change skips; the window start is computed on the zone-free value.
    """
    return F.window(time, "1 hour")["start"]


def hours_between(first: Column, last: Column) -> Column:
    """Array of the hours ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))


def hour_text(hour: Column) -> Column:
    return F.date_format(hour, "yyyy-MM-dd HH:00:00")


def hour_label(hour: Column) -> Column:
    return F.date_format(hour, "dd MMM hh a")
