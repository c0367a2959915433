"""Readers: the three source tables and the road lists, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from lanescope.schema import ROADS

#: The column that holds a line which could not be split into the declared fields.
LINE = "_line"


def conform(table: DataFrame, schema: StructType, day_column: str | None = None) -> DataFrame:
    """The declared columns in the declared types; a text that is no number becomes NULL.

    ``day_column`` is kept besides, for a ``Slicer`` that names it.
    """
    declared = [
        F.col(f.name) if table.schema[f.name].dataType == f.dataType
        else F.col(f.name).try_cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return table.select(*declared, *([day_column] if day_column else []))


def read_table(
    spark: SparkSession, schema: StructType, path: str | None = None, fmt: str = "parquet",
    day_column: str | None = None, typed: bool = False, **options: str,
) -> DataFrame:
    """A source table from files or, with ``fmt="jdbc"`` and ``jdbc_options``, a database.

    CSV files are parsed with the declared schema; other formats carry their own types and are
    brought to the declared ones. ``day_column`` names a partition column of a lake by day.
    ``typed`` files are known to hold the declared types, such as those this package wrote: none is
    opened to find its schema before the query runs.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        return reader.option("header", True).schema(schema).load(path)
    if typed:
        day = [StructField(day_column, DateType())] if day_column else []
        return reader.schema(StructType([*schema, *day])).load(path)
    return conform(reader.load(path) if path else reader.load(), schema, day_column)


def read_checked(
    spark: SparkSession, schema: StructType, path: str, fmt: str = "parquet", **options: str,
) -> tuple[DataFrame, DataFrame, Observation]:
    """The table as ``read_table`` gives it, the rows with unreadable values, and their counts.

    A value is unreadable if it is there and becomes NULL in its declared type; a CSV line with too
    few or too many fields is unreadable as a whole.  The second table holds such rows as the source
    has them, all fields as text for CSV, with ``unreadable``: the names of those columns, or
    ``_line`` for a line.  Both are lazy.  The observation has the number of rows and of unreadable
    values by column, counted while the first table is computed for the first time, at no extra read.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        texts = StructType([StructField(f.name, StringType()) for f in schema])
        raw = (
            reader.option("header", True).option("columnNameOfCorruptRecord", LINE)
            .option("enforceSchema", True).schema(texts.add(LINE, StringType())).load(path)
        )
    else:
        raw = reader.load(path)
    broken = {
        f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in schema if raw.schema[f.name].dataType != f.dataType
    }
    if fmt == "csv":
        broken[LINE] = F.col(LINE).isNotNull()
    counts = Observation()
    observed = raw.observe(
        counts, F.count("*").alias("rows"), *[F.count_if(test).alias(name) for name, test in broken.items()]
    )
    names = F.array_compact(F.array(
        *[F.when(test, F.lit(name)) for name, test in broken.items()], F.lit(None).cast("string")
    ))
    aside = raw.withColumn("unreadable", names).where(F.size("unreadable") > 0)
    return conform(observed, schema), aside, counts


def unreadable_values(table: DataFrame, schema: StructType) -> DataFrame:
    """One row per declared column: values that are there, and those that its type can't hold."""
    tests = [
        F.struct(
            F.lit(f.name).alias("column"), F.count(f.name).alias("present"),
            F.count_if(
                F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
            ).alias("unreadable"),
        )
        for f in schema
    ]
    return table.agg(F.array(*tests).alias("columns")).select(F.inline("columns"))


def jdbc_options(
    url: str, table: str, partition_column: str | None = None, lower: str | None = None,
    upper: str | None = None, partitions: int = 64, fetch_size: int = 10_000, **extra: str,
) -> dict[str, str]:
    """Options for a database read split into ranges of ``partition_column``.

    Without a partition column one task reads the whole table, which suits the cameras only.
    Bounds place the splits and drop no rows.
    """
    options = {
        "url": url, "dbtable": table, "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true", **extra,
    }
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs a lower and an upper bound")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions),
        }
    return options


def read_important_roads(
    spark: SparkSession, hotspots: str, in_out: str, fmt: str = "csv", column: str = "road"
) -> tuple[DataFrame, DataFrame]:
    """The two road lists; the first one is the domain of the road selection.

    ``column`` names the road in files that call it otherwise; it holds text.
    """
    declared = StructType([StructField(column, ROADS["road"].dataType)])
    return tuple(
        read_table(spark, declared, path, fmt, typed=True).withColumnRenamed(column, "road")
        for path in (hotspots, in_out)
    )
