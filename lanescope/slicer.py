"""The user's selection: an hour span, roads and directions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanescope.schema import DEFAULT_WINDOW_DAYS, LOCAL_ZONE

HOUR = timedelta(hours=1)


def _whole_hour(moment: datetime) -> datetime:
    return moment.replace(minute=0, second=0, microsecond=0)


@dataclass(frozen=True)
class Slicer:
    """Hours ``start`` to ``end``, both included; ``None`` leaves that side open.

    An empty ``roads`` or ``directions`` selects nothing. ``day_column`` names a column that holds
    the date of ``time``, such as the partitions of ``sources.write_by_day``; it is only used to
    read fewer files.
    """

    roads: tuple[str, ...]
    directions: tuple[str, ...]
    start: datetime | None = None
    end: datetime | None = None
    day_column: str | None = None

    def __post_init__(self):
        for field in ("roads", "directions"):
            value = getattr(self, field)
            if isinstance(value, str):
                raise TypeError(f"{field} takes a sequence of names, not one string")
            object.__setattr__(self, field, tuple(value))
        for field in ("start", "end"):
            moment = getattr(self, field)
            if moment is not None:
                if moment.tzinfo is not None:
                    raise ValueError(f"{field} is a local time without a zone")
                object.__setattr__(self, field, _whole_hour(moment))

    @classmethod
    def latest(cls, roads, directions, now: datetime | None = None) -> Slicer:
        """The default span: the last two days up to the current hour."""
        if now is None:
            now = datetime.now(ZoneInfo(LOCAL_ZONE)).replace(tzinfo=None)
        end = _whole_hour(now)
        return cls(roads, directions, end - timedelta(days=DEFAULT_WINDOW_DAYS), end)

    @classmethod
    def between_labels(cls, roads, directions, first: str, last: str, year: int) -> Slicer:
        """Span from slider labels such as ``03 Jan 05 AM``; the year is not in the label.

        A span that crosses New Year ends in the following year.
        """
        start, end = (datetime.strptime(f"{label} {year}", "%d %b %I %p %Y") for label in (first, last))
        if end < start:
            end = end.replace(year=year + 1)
        return cls(roads, directions, start, end)

    def in_span(self, facts: DataFrame) -> DataFrame:
        """Keep rows of the span by a plain range on ``time``.

        The bare column reaches the Parquet or JDBC reader, which a formatted hour would not; so
        does ``day_column``, where one is named. A row without a time lies in no span.
        """
        facts = facts.where(F.col("time").isNotNull())
        if self.start is not None:
            facts = facts.where(F.col("time") >= _moment(self.start))
            if self.day_column:
                facts = facts.where(F.col(self.day_column) >= F.lit(self.start.date()))
        if self.end is not None:
            facts = facts.where(F.col("time") < _moment(self.end + HOUR))
            if self.day_column:
                facts = facts.where(F.col(self.day_column) <= F.lit(self.end.date()))
        return facts

    def in_direction(self, column: str) -> Column:
        return F.col(column).isin(*self.directions)


def _moment(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
