"""A lake of fact state by day: late rows change the days they belong to, and no others."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.operators import state
from lanescope.session import settle

DAY = "day"


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored state with its ``day``; None where nothing was stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def add_to_state(new: DataFrame, path: str, scratch: str | None = None) -> list[date]:
    """Merge the state of new rows into the lake at ``path``; returns the days that were written.

    The rows must not have been added before.  Only the days among them are read and replaced, each
    by the merged state, which is complete in ``scratch`` before the first file of the lake changes:
    a lost executor costs tasks, and a job that fails leaves the lake as it was.  No rows change
    nothing.
    """
    new = settle(new.withColumn(DAY, F.to_date("datetime")), scratch)
    # One row per day of the new rows reaches the driver, so that other days' files aren't listed.
    days = sorted(row[DAY] for row in new.select(DAY).distinct().collect())
    if not days:
        return []
    old = read_state(new.sparkSession, path)
    if old is not None:
        touched = old.where(F.col(DAY).isin(*days)).select(*new.columns)
        new = settle(state.merged(touched, new), scratch)
    replace_days(new, path)
    return days


def replace_days(new: DataFrame, path: str) -> None:
    """Write the state of whole days, in place of what the lake holds of them.

    For days whose raw rows were corrected: their state is made anew from all their rows.
    """
    table = new if DAY in new.columns else new.withColumn(DAY, F.to_date("datetime"))
    (
        table.hint("rebalance", DAY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY).parquet(path)
    )
