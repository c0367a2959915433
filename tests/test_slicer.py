from datetime import datetime

import pytest
from conftest import at
from pyspark.sql import functions as F

from lanescope import Slicer
from lanescope.functions import hour_of
from lanescope.operators.hourly import default_hours, hour_calendar


def test_default_span_is_two_days_back_to_the_current_hour():
    slicer = Slicer.latest(["R"], ["IN"], now=datetime(2024, 3, 1, 10, 42, 7))
    assert (slicer.start, slicer.end) == (datetime(2024, 2, 28, 10), datetime(2024, 3, 1, 10))


def test_labels_carry_no_year():
    slicer = Slicer.between_labels(["R"], ["IN"], "31 Dec 11 PM", "01 Jan 02 AM", year=2023)
    assert (slicer.start, slicer.end) == (datetime(2023, 12, 31, 23), datetime(2024, 1, 1, 2))


def test_a_single_name_is_refused():
    with pytest.raises(TypeError):
        Slicer("ROAD", ["IN"])


def test_one_hour_span_keeps_that_hour_only(events_of):
    rows = events_of(*[
        (moment, 1, "IN", "b2t_1", "error", "car", None)
        for moment in (at(4, 59), at(5, 0), at(5, 59), at(6, 0), None)
    ])
    kept = Slicer(["R"], ["IN"], at(5), at(5, 30)).in_span(rows)
    assert sorted(row.time for row in kept.collect()) == [at(5, 0), at(5, 59)]


def test_open_span_drops_rows_without_a_time(events_of):
    rows = events_of((at(5), 1, "IN", "z", "error", "car", None), (None, 1, "IN", "z", "e", "c", None))
    assert Slicer(["R"], ["IN"]).in_span(rows).count() == 1


def test_calendar_has_49_hours_and_labels(spark):
    now = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-01 10:00:00' AS now")
    rows = default_hours(now).orderBy("datetime").collect()
    assert len(rows) == 49
    assert rows[0].hour_text == "2024-02-28 10:00:00" and rows[0].label == "28 Feb 10 AM"
    assert rows[-1].datetime == datetime(2024, 3, 1, 10)


def test_calendar_between_two_hours(spark):
    bounds = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-01 22:00:00' AS a, TIMESTAMP_NTZ '2024-01-02 01:00:00' AS b"
    )
    hours = [row.datetime.hour for row in hour_calendar("a", "b", bounds).collect()]
    assert hours == [22, 23, 0, 1]


def test_hour_does_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist in New York on that day.
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS t").select(
            hour_of(F.col("t")).alias("h")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.h == datetime(2024, 3, 10, 2)
