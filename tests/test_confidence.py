from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanescope.functions import detection_confidence

CASES = [
    ("person_on_lane", '{"id":1,"conf":0.93,"x":1}', "0.9300"),
    ("accident", '{"confidence":0.93}', "0.9300"),
    ("illegal_stop", '{"confidence":0.93}', "0.9300"),
    ("accident", "{}", "0.0000"),
    ("accident", "", "0.0000"),
    ("accident", None, None),
    ("error", '{"confidence":0.93}', None),
    (None, '{"confidence":0.93}', None),
    ("person_on_lane", '{"conf": 0.5,"x":1}', "0.5000"),
    ("person_on_lane", '{"conf":\t0.5}', "0.5000"),
    ("person_on_lane", '{"conf":-0.25}', "-0.2500"),
    ("person_on_lane", '{"conf":+.25}', "0.2500"),
    ("person_on_lane", '{"conf":1.}', "1.0000"),
    ("person_on_lane", '{"conf":9e-1}', "0.9000"),
    ("person_on_lane", '{"conf":9e}', "9.0000"),
    ("person_on_lane", '{"conf":0.12345}', "0.1235"),
    ("person_on_lane", '{"conf":0.000049999999999}', "0.0000"),
    ("person_on_lane", '{"conf":12.5}', "9.9999"),
    ("person_on_lane", '{"conf":-12.5}', "-9.9999"),
    ("person_on_lane", '{"conf":9.99999}', "9.9999"),
    ("person_on_lane", '{"conf":"0.93"}', "0.0000"),
    ("person_on_lane", '{"confidence":0.93}', "0.0000"),
    ("person_on_lane", '{"conf":0.1,"conf":0.2}', "0.2000"),
    ("accident", "0.7, no field", "0.7000"),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = spark.createDataFrame(
        [(i, kind, text) for i, (kind, text, _) in enumerate(CASES)],
        "i INT, event_type STRING, description STRING",
    )
    conf = detection_confidence(F.col("event_type"), F.col("description")).alias("conf")
    out = rows.select("i", conf)
    assert out.schema["conf"].dataType.simpleString() == "decimal(5,4)"
    return {row.i: row.conf for row in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{CASES[i][1]}")
def test_confidence(results, i):
    expected = CASES[i][2]
    assert results[i] == (None if expected is None else Decimal(expected))
