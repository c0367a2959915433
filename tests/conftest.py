from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lanescope.schema import CAMERAS, EVENTS, VOLUMES  # noqa: E402
from lanescope.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(request):
    """A cached table would take the place of the real plan in every later test."""
    yield
    if "spark" in request.fixturenames or SparkSession.getActiveSession() is not None:
        SparkSession.getActiveSession().catalog.clearCache()


def at(hour: int, minute: int = 0, day: int = 1) -> datetime:
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture
def cameras_of(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), CAMERAS)

    return build


@pytest.fixture
def events_of(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), EVENTS)

    return build


@pytest.fixture
def volumes_of(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), VOLUMES)

    return build
