"""Exact median of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanescope.session import settle

# Ranks of an approximate percentile are off by at most 1/ACCURACY of the group, so that the true
# median lies between these two approximate percentiles.
ACCURACY = 10_000
BRACKET = (0.499, 0.501)


def bracket_of(value: str) -> list[Column]:
    """Aggregates that ``median_within`` needs of each group, to go with others of one pass."""
    return [
        F.percentile_approx(value, list(BRACKET), ACCURACY).alias("_bracket"),
        F.count(value).alias("_n"),
    ]


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """One row per key with the median of ``value``, the mean of the middle two for an even count.

    The built-in median keeps all values of a group in one task. Here approximate percentiles
    bracket the median first; values below and above the bracket are only counted, on the map
    side, and equal values are counted together, so a small share of the group is ever sorted.
    Groups without a value have no row.
    """
    rows = rows.where(F.col(value).isNotNull())
    summary = rows.groupBy(*keys).agg(*bracket_of(value))
    return median_within(rows, summary, keys, value, name)


def median_within(
    rows: DataFrame, summary: DataFrame, keys: Sequence[str], value: str, name: str
) -> DataFrame:
    """``summary`` with the median as ``name``, found by the brackets that it holds.

    The middle of a group whose bracket misses it lies on a known side; that side is bracketed
    again, in rounds, until no group is left. Each round drops at least the bracket's own values,
    so that the rounds end. A round is computed here and written, one row per group; the first one
    nearly always settles all groups.
    """
    keys, own = list(keys), [c for c in summary.columns if c not in ("_bracket", "_n")]
    # The ranks of the middle two, and the open range that holds those still to be found.
    middle = summary.withColumns({
        "_lower": F.floor((F.col("_n") + 1) / 2), "_upper": F.floor(F.col("_n") / 2) + 1,
        "_over": F.lit(None).cast(rows.schema[value].dataType),
        "_under": F.lit(None).cast(rows.schema[value].dataType),
    }).drop("_n")
    values = rows.select(*keys, value).where(F.col(value).isNotNull())
    done = []
    while True:
        settled = settle(_counted(values, middle, keys, value))
        found = F.col("_first").isNotNull()
        done.append(settled.where(found).select(*own, ((F.col("_first") + F.col("_second")) / 2).alias(name)))
        left = settled.where(~found)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, done)
        middle = _bracketed_again(values, left, keys, value)


def _in_range(value: str) -> Column:
    """Rows within the open range (_over, _under), whose ends may be NULL for none."""
    over, under = F.col(value) > F.col("_over"), F.col(value) < F.col("_under")
    return F.coalesce(over, F.lit(True)) & F.coalesce(under, F.lit(True))


def _counted(values: DataFrame, middle: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``middle`` with the middle two values (_first, _second), or the range where they lie.

    Of values on either side of the bracket, the number and the nearest one are known, so that a
    middle between two neighbours needs no further round where only one of them is inside.
    """
    below, above = F.col(value) < F.col("_bracket")[0], F.col(value) > F.col("_bracket")[1]
    side = F.when(below, -1).when(above, 1).otherwise(0)
    sought = middle.select(*keys, "_bracket", "_lower", "_upper", "_over", "_under")
    counted = (
        values.join(sought, keys).where(_in_range(value))
        .withColumn("_side", side)
        .groupBy(*keys, "_side", F.when(F.col("_side") == 0, F.col(value)).alias("_value"))
        .agg(
            F.count("*").alias("_count"), F.first("_lower").alias("_lower"),
            F.first("_upper").alias("_upper"),
            F.min(value).alias("_least"), F.max(value).alias("_most"),
        )
    )
    upto = (
        Window.partitionBy(*keys).orderBy("_side", "_value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_rank", F.sum("_count").over(upto))

    def at(rank: str) -> Column:
        """The value of a rank: any inside, the nearest one below and above, else NULL."""
        here = (F.col("_rank") >= F.col(rank)) & (F.col("_rank") - F.col("_count") < F.col(rank))
        nearest = F.when(F.col("_side") == 0, F.col("_value")).when(
            (F.col("_side") < 0) & (F.col("_rank") == F.col(rank)), F.col("_most")
        ).when(
            (F.col("_side") > 0) & (F.col("_rank") - F.col("_count") + 1 == F.col(rank)),
            F.col("_least"),
        )
        return F.max(F.when(here, nearest))

    n_below = F.coalesce(F.sum(F.when(F.col("_side") < 0, F.col("_count"))), F.lit(0))
    n_to_above = F.coalesce(F.sum(F.when(F.col("_side") <= 0, F.col("_count"))), F.lit(0))
    sides = ranked.groupBy(*keys).agg(
        at("_lower").alias("_first"), at("_upper").alias("_second"),
        n_below.alias("_below"), n_to_above.alias("_to_above"),
    )
    both = F.col("_first").isNotNull() & F.col("_second").isNotNull()
    low = F.col("_upper") <= F.col("_below")  # else the middle lies above, where it is not found
    skipped = F.when(low, F.lit(0)).otherwise(F.col("_to_above"))
    return middle.join(sides, keys).withColumns({
        "_first": F.when(both, F.col("_first")), "_second": F.when(both, F.col("_second")),
        "_over": F.when(low, F.col("_over")).otherwise(F.col("_bracket")[1]),
        "_under": F.when(low, F.col("_bracket")[0]).otherwise(F.col("_under")),
        "_lower": F.col("_lower") - skipped, "_upper": F.col("_upper") - skipped,
    }).drop("_below", "_to_above")


def _bracketed_again(values: DataFrame, left: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``left`` with a new bracket around the sought ranks of the range that holds them."""
    left = left.drop("_first", "_second", "_bracket")
    inside = values.join(left.select(*keys, "_over", "_under", "_lower", "_upper"), keys).where(_in_range(value))
    quantiles = F.percentile_approx(value, list(_steps()), ACCURACY)
    ranges = inside.groupBy(*keys, "_lower", "_upper").agg(quantiles.alias("_steps"), F.count("*").alias("_n"))
    # The last step below the lower rank and the first one above the upper, a step's width apart.
    width = len(_steps()) - 1
    first = F.greatest(F.floor(width * (F.col("_lower") - 1) / F.col("_n")) - 1, F.lit(0))
    last = F.least(F.ceil(width * F.col("_upper") / F.col("_n")) + 1, F.lit(width))
    bracket = F.array(F.get("_steps", first.cast("int")), F.get("_steps", last.cast("int")))
    return left.join(ranges.select(*keys, bracket.alias("_bracket")), keys)


def _steps() -> tuple[float, ...]:
    return tuple(i / 500 for i in range(501))
