"""Where intermediate tables go."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanescope.session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_root(spark)}/lanescope-{uuid.uuid4().hex}"


def written(frame: DataFrame, **options: str) -> DataFrame:
    """The frame written as Parquet to a shared folder and read back: it survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release() -> None:
    """Give back to the system what numpy and Arrow have freed: a driver lives on after a training."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim is not None:
            trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; a worker gives back what it has freed after each, as it waits for later stages."""
    for batch in batches:
        yield batch
        del batch
        release()
