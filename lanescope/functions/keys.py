"""Rows whose keys are all present."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every column.

    Plain ``IS NOT NULL`` filters, not ``dropna``: the optimizer adds the same ones below joins,
    so the branches of a self-join keep the same plan and share one shuffle.
    """
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
