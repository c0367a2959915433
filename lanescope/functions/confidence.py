"""Detection confidence cut out of the event description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanescope.schema import CONFIDENCE_FIELD

# What a lenient numeric cast reads from the front of a text.
NUMERIC_PREFIX = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"


def confidence_number(event_type: Column, description: Column) -> Column:
    """The leading number, as text, after the last field name up to the next comma.

    Empty where there is none, NULL where the event type carries no confidence.
    """
    field = F.lit(None).cast("string")
    for kind, name in CONFIDENCE_FIELD.items():
        field = F.when(event_type == kind, F.lit(name)).otherwise(field)
    after = F.call_function("substring_index", description, field, F.lit(-1))
    return F.regexp_extract(F.substring_index(after, ",", 1), NUMERIC_PREFIX, 1)


def confidence_of(number: Column) -> Column:
    """Such a number as ``decimal(5,4)``.

    It is read the lenient way: no number at all counts as 0, and one out of range is clipped to the
    widest value the type holds. ``number`` is used several times here, so let it be a column of a
    projection below, which extracts it once per row.
    """
    widest = F.lit("9.9999").cast("decimal(5,4)")
    return (
        F.when(number == "", F.lit(0).cast("decimal(5,4)"))
        .when(
            number.isNotNull(),
            F.coalesce(
                number.try_cast("decimal(5,4)"),
                F.when(number.startswith("-"), -widest).otherwise(widest),
            ),
        )
    )


def detection_confidence(event_type: Column, description: Column) -> Column:
    """Confidence as ``decimal(5,4)``, NULL where the event type or the description carries none."""
    return confidence_of(confidence_number(event_type, description))
