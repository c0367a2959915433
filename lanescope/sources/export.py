"""Writers: CSV exports, and lakes partitioned by day, plain or clustered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hour, and of the camera's rank, in the order of a clustered lake.
CLUSTER_BITS = 5
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def write_csv(result: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header, one file per partition, no row index."""
    (
        result.write.mode("overwrite")
        .options(header=True, encoding="UTF-8", timestampNTZFormat=TIME_FORMAT)
        .csv(path)
    )


def write_by_day(table: DataFrame, path: str, time: str = "time") -> None:
    """Parquet partitioned by ``day``, so that a span of hours reads its own days only.

    Days among the rows are replaced, other days of the lake stay. The rebalance hint lets adaptive
    execution split a heavy day over several tasks and files and merge light ones.
    """
    (
        table.withColumn("day", F.to_date(time))
        .hint("rebalance", "day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )


def _interleaved(first: Column, second: Column, bits: int) -> Column:
    """The low bits of two numbers in turns, those of ``first`` in front."""

    def spread(value: Column, shift: int) -> Column:
        parts = [
            F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), 2 * bit + shift)
            for bit in range(bits)
        ]
        return reduce(Column.bitwiseOR, parts)

    return spread(first.cast("long"), 1).bitwiseOR(spread(second.cast("long"), 0))


def write_clustered(
    table: DataFrame, path: str, time: str = "time", camera: str = "camera_id",
    row_group_bytes: int = 16 << 20, page_rows: int = 20_000,
) -> None:
    """A lake by day whose files keep neighbouring hours and cameras together.

    Within a day rows follow an order that interleaves the bits of the hour and of the camera's
    rank among the cameras (``CLUSTER_BITS`` each), so that a row group, of ``row_group_bytes`` at
    most, spans few hours and few cameras at once: statistics of row groups and page indexes then
    rule most of them out for a selection of cameras, of hours, or of both.  A range exchange on
    (day, order) splits a heavy day, and a hot camera, over several files.  Ranks come from
    approximate percentiles, so that a few busy cameras do not share one range; they place rows and
    drop none.  Days among the rows are replaced, other days of the lake stay.
    """
    steps = 1 << CLUSTER_BITS
    # A bounded list of camera ids reaches the driver: the boundaries of 2^CLUSTER_BITS ranges.
    cuts = table.agg(
        F.percentile_approx(camera, [k / steps for k in range(1, steps)], 10 * steps).alias("cuts")
    ).first().cuts or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast(f"array<{table.schema[camera].dataType.simpleString()}>")
    rank = F.size(F.filter(cuts, lambda x: x < F.col(camera)))
    order = _interleaved(F.hour(time), F.coalesce(rank, F.lit(0)), CLUSTER_BITS)
    placed = table.withColumns({"day": F.to_date(time), "_order": order})
    (
        placed.repartitionByRange("day", "_order", time)
        .sortWithinPartitions("day", "_order", camera, time).drop("_order")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .partitionBy("day").parquet(path)
    )
