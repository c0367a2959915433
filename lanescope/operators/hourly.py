"""Regular hourly series: every hour present, gaps filled from the hour before.

A series is what shares the key columns. All series of one table span the same hours, from the
first to the last hour in which any of them was observed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanescope.functions import hour_label, hour_text, hours_between, present
from lanescope.schema import DEFAULT_WINDOW_DAYS

HOUR = "datetime"
#: Series in a task where their number is known; a year of hours of each is 1.8 million rows.
SERIES_PER_TASK = 200


def hour_calendar(first: Column | str, last: Column | str, bounds: DataFrame) -> DataFrame:
    """Every hour from ``first`` to ``last`` of each row of ``bounds``, with its two labels."""
    return bounds.select(
        F.explode(hours_between(_column(first), _column(last))).alias(HOUR)
    ).withColumns({"hour_text": hour_text(F.col(HOUR)), "label": hour_label(F.col(HOUR))})


def default_hours(now: DataFrame, column: str = "now") -> DataFrame:
    """The default calendar: two days back from the hour in ``column`` up to that hour."""
    back = F.expr(f"INTERVAL {DEFAULT_WINDOW_DAYS} DAYS")
    return hour_calendar(F.col(column) - back, F.col(column), now)


def _column(name: Column | str) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _span(observed: DataFrame) -> Column:
    """First and last observed hour of all series, as one scalar subquery.

    It needs what the filters of ``observed`` need, so Spark reuses the shuffle under both and the
    facts are read once.
    """
    bounds = F.struct(F.min(HOUR).alias("first"), F.max(HOUR).alias("last"))
    return observed.agg(bounds.alias("span")).scalar()


def fill_hours(
    observed: DataFrame, keys: Sequence[str], value: str, parts: int | None = None
) -> DataFrame:
    """Regular series of ``value``, a missing hour taking the last value before it.

    ``observed`` holds at most one row per key and hour. Each observation is spread over the hours
    up to the next one of its series, so no hour grid has to be joined. Hours before a series'
    first observation are NULL. ``gap`` marks the hours without an observation of their own.

    ``parts`` is the number of tasks that the series are dealt to, for tables of many series
    (``parts_for``): Spark sizes tasks by the observations, which are far fewer than the hours they
    are spread over, and later windows sort those. By default Spark chooses.
    """
    observed = observed.where(F.col(value).isNotNull())
    dealt = observed if parts is None else observed.repartition(parts, *keys)
    series = Window.partitionBy(*keys).orderBy(HOUR)
    starts = F.when(F.col("_before").isNull(), F.col("_span.first")).otherwise(F.col(HOUR))
    ends = F.coalesce(F.col("_after") - F.expr("INTERVAL 1 HOUR"), F.col("_span.last"))
    spread = dealt.select(
        *keys, HOUR, value, F.lag(HOUR).over(series).alias("_before"),
        F.lead(HOUR).over(series).alias("_after"), _span(observed).alias("_span"),
    ).select(
        *keys, F.explode(hours_between(starts, ends)).alias("_hour"), F.col(HOUR).alias("_seen"),
        value,
    )
    return spread.select(
        F.col("_hour").alias(HOUR), *keys,
        F.when(F.col("_hour") >= F.col("_seen"), F.col(value)).alias(value),
        (F.col("_hour") != F.col("_seen")).alias("gap"),
    )


def parts_for(n_series: int) -> int:
    """Tasks for so many series, ``SERIES_PER_TASK`` in each, about."""
    return 1 + n_series // SERIES_PER_TASK


def fill_counts(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Regular series of counts: 0 in an observed hour, the previous hour's count in a gap.

    An hour is observed if any key has a count in it, so a key missing there counts 0, while an
    hour missing altogether repeats the one before. ``gap`` marks the latter.
    """
    counts = counts.where(F.col(value) > 0)
    hours = F.explode(hours_between(F.col("_span.first"), F.col("_span.last"))).alias(HOUR)
    grid = (
        counts.select(key).distinct().withColumn("_span", _span(counts)).select(key, hours)
    )
    seen = counts.select(HOUR).distinct().withColumn("_seen", F.lit(True))
    own = F.when(F.col("_seen"), F.coalesce(F.col(value), F.lit(0)))
    upto = Window.partitionBy(key).orderBy(HOUR).rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(counts, [key, HOUR], "left")
        .join(seen, HOUR, "left")
        .select(
            HOUR, key, F.last(own, ignorenulls=True).over(upto).alias(value),
            F.col("_seen").isNull().alias("gap"),
        )
    )


def rolling_mean(series: DataFrame, keys: Sequence[str], value: str, hours: int, name: str) -> DataFrame:
    """Mean of the last ``hours`` rows of a regular series, NULL unless all hold a value."""
    frame = Window.partitionBy(*keys).orderBy(HOUR).rowsBetween(1 - hours, 0)
    full = F.count(value).over(frame) == hours
    return series.withColumn(name, F.when(full, F.avg(value).over(frame)))


def hourly_confidence(facts: DataFrame) -> DataFrame:
    """Hourly mean confidence per event type, gap-filled, then smoothed over three hours."""
    means = (
        present(facts, "event_type")
        .groupBy(HOUR, "event_type")
        .agg(F.avg("confidence").alias("confidence"))
    )
    return rolling_mean(
        fill_hours(means, ["event_type"], "confidence"), ["event_type"], "confidence", 3, "smoothed"
    )


def hourly_event_count(facts: DataFrame, direction: str) -> DataFrame:
    """Hourly event counts per event type in one direction."""
    counts = (
        present(facts, HOUR, "event_type")
        .where(F.col("direction") == direction)
        .groupBy(HOUR, "event_type")
        .agg(F.count("*").alias("events"))
    )
    return fill_counts(counts, "event_type", "events")


def hourly_los(
    facts: DataFrame, keys: Sequence[str] = ("destination",), parts: int | None = None
) -> DataFrame:
    """Hourly mean level of service per key, gap-filled; by default one series per destination."""
    means = present(facts, *keys).groupBy(HOUR, *keys).agg(F.avg("LOS").alias("LOS"))
    return fill_hours(means, keys, "LOS", parts)
