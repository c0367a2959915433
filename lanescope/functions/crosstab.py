"""Cross-tabs in long form over the values that the data hold, and a formatter to wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_counts(rows: DataFrame, key: str, column: str, name: str = "events") -> DataFrame:
    """Rows of every observed key with every observed value of ``column``, 0 where none occurred.

    The values are one array, a scalar subquery over the counts; no key is joined with all values.
    """
    counts = rows.groupBy(key, column).agg(F.count("*").alias(name))
    values = counts.agg(F.array_sort(F.collect_set(column)).alias("values")).scalar()
    by_value = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(column, name))).alias("_by_value")
    )
    return by_value.select(key, "_by_value", F.explode(values).alias(column)).select(
        key, column, F.coalesce(F.col("_by_value")[F.col(column)], F.lit(0)).alias(name)
    )


def widen(table: DataFrame, key: str, column: str, name: str, listed: Sequence[str]) -> DataFrame:
    """A long cross-tab with one column per listed value; a value that is not listed is an error."""
    known = F.when(F.col(column).isin(*listed), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} is not listed: "), F.col(column)))
    )
    return (
        table.select(key, known.alias("_known"), name)
        .groupBy(key)
        .agg(*[F.max(F.when(F.col("_known") == x, F.col(name))).alias(x) for x in listed])
    )
