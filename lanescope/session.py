"""Session settings the operators are written for."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot camera in the shuffle join too, where a second join on the camera follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The camera table is broadcast only below this size; beyond it the joins shuffle.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above 8000 bytes; let Spark split such stages instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A dashboard runs the same few dozen plans again and again; keep their compiled stages.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own master and sizes."""
    return (
        configure(SparkSession.builder.master(f"local[{cores}]").appName("lanescope"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python line of every column doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _folder_of_this_process() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lanescope-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, the session's ``spark.checkpoint.dir``.

    Where that is unset, a session whose tasks run in the driver's own process takes a temporary
    folder of that process; any other has no folder that all its executors see, and fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _folder_of_this_process()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def settle(table: DataFrame, scratch: str | None = None) -> DataFrame:
    """Compute a table that several results share once: write it as Parquet and read it back.

    A lost executor costs nothing that is already there, and later results still read only their
    columns and rows. ``scratch`` is a folder on storage that the whole cluster shares, by default
    that of ``shared_root``.
    """
    spark = table.sparkSession
    scratch = scratch or shared_root(spark)
    path = f"{scratch.rstrip('/')}/settled-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
