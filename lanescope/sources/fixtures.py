"""The three source tables derived from the benchmark tables (FIXTURES.md, section 3).

Every row of ``events``, ``lineitem`` and ``supplier`` becomes a row of its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.schema import CAMERAS, EVENTS, VOLUMES
from lanescope.sources.tables import conform, read_important_roads


# Declared, so that no read has to open files for their schema first.
COLUMNS = {
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
                   l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING,
                   l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def cameras(spark: SparkSession, folder: str) -> DataFrame:
    """One camera per supplier; the road is its region, some latitudes are missing."""
    supplier, nation, region = (_table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return conform(
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .selectExpr(
            "s_suppkey AS camera_id",
            "concat('EQ-', CAST(s_nationkey AS STRING)) AS equipment_id",
            "r_name AS address",
            """CASE WHEN s_suppkey % 23 = 22 THEN NULL
                    ELSE CAST(3.0 + (s_suppkey % 50) * 0.01 AS DOUBLE) END AS latitude""",
            "CAST(101.5 + (s_suppkey % 40) * 0.01 AS DOUBLE) AS longitude",
        ),
        CAMERAS,
    )


def camera_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The cameras as a text export may hold them: some ids and coordinates are no numbers."""
    texts = cameras(spark, folder).select(*[F.col(f.name).cast("string") for f in CAMERAS])
    return texts.withColumns({
        "camera_id": F.expr("CASE WHEN camera_id % 7 = 3 THEN concat('C', camera_id) ELSE camera_id END"),
        "longitude": F.expr("CASE WHEN camera_id % 5 = 1 THEN 'unknown' ELSE longitude END"),
    })


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with missing directions and zones, and descriptions without the field."""
    return conform(
        _table(spark, folder, "events")
        .selectExpr(
            "*",
            """CASE event_type WHEN 'click' THEN 'person_on_lane' WHEN 'view' THEN 'illegal_stop'
                    WHEN 'purchase' THEN 'accident' ELSE event_type END AS et""",
            "lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0') AS kk",
        )
        .selectExpr(
            "ts AS time",
            "user_id AS camera_id",
            """CASE WHEN event_id % 5 IN (0, 1) THEN 'IN'
                    WHEN event_id % 5 IN (2, 3) THEN 'OUT' END AS direction""",
            """CASE WHEN event_id % 17 = 0 THEN NULL
                    ELSE concat(CASE WHEN user_id % 2 = 0 THEN 'b2t_' ELSE 't2b_' END,
                                CAST(event_id % 3 + 1 AS STRING)) END AS zone""",
            "et AS event_type",
            """CASE event_id % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'lorry' WHEN 2 THEN 'motorbike'
                    ELSE 'person' END AS item_type""",
            """CASE WHEN event_id % 19 = 0 THEN '{}'
                    WHEN et = 'person_on_lane' THEN concat('{"id":1,"conf":0.', kk, ',"x":1}')
                    ELSE concat('{"id":1,"confidence":0.', kk, '}') END AS description""",
        ),
        EVENTS,
    )


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicle counts of every supplier's camera; a day of the shipping dates is an hour here.

    Hours without a row, and every eleventh hour, are gaps.
    """
    return conform(
        _table(spark, folder, "lineitem")
        .selectExpr(
            "*",
            """CASE l_partkey % 7 WHEN 0 THEN 'ALL' WHEN 1 THEN 'bus' WHEN 2 THEN 'car'
                    WHEN 3 THEN 'lorry' WHEN 4 THEN 'truck' WHEN 5 THEN 'van'
                    ELSE 'motorbike' END AS vehicle_type""",
            "CAST(datediff(l_shipdate, DATE '1995-01-01') AS INT) AS h",
        )
        .selectExpr(
            """TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(
                    0, CAST(h * 11 div 10 AS INT), CAST(l_partkey % 60 AS INT)) AS time""",
            "l_suppkey AS camera_id",
            "CASE l_returnflag WHEN 'A' THEN 'IN' WHEN 'N' THEN 'OUT' END AS destination",
            """concat(CASE l_linestatus WHEN 'F' THEN 'b2t_' ELSE 't2b_' END,
                      CAST(l_linenumber % 3 + 1 AS STRING)) AS zone""",
            "vehicle_type",
            """CAST(l_quantity AS INT)
                    * CASE WHEN vehicle_type = 'ALL' THEN 8 ELSE 1 END AS agg_count""",
            """CASE WHEN l_orderkey % 29 = 0 THEN NULL
                    ELSE CAST(floor(l_discount * 100 + 0.5) - 1 AS INT) * 10 END AS avg_speed""",
        ),
        VOLUMES,
    )


def important_roads(spark: SparkSession, folder: str) -> DataFrame:
    """The first of the two road lists, through their reader; here both are the regions' names."""
    path = f"{folder}/region.parquet"
    return read_important_roads(spark, path, path, "parquet", "r_name")[0]
