"""Series views over the given tables: (track, frame, left, right).

Each view is a narrow projection, so column pruning and filters reach the
parquet scan. Frames are integers on the track's own clock.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 3600      # frames per catalogue second of the event series
HOP = 360        # 100 ms
EPOCH = "2024-01-01"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def event_samples(spark: SparkSession, root: str) -> DataFrame:
    """Events as a sparse two-channel signal, one frame per minute, one track per user.

    The event type is the pan: left only, right only, both equal, opposite sign,
    or left-weighted. Frames without an event are digital silence.
    """
    return pan(table(spark, root, "events"))


def pan(e: DataFrame) -> DataFrame:
    x = F.col("value") / 100
    frame = (
        F.datediff(F.col("ts").cast("date"), F.lit(EPOCH).cast("date")).cast("bigint") * 1440
        + F.hour("ts") * 60
        + F.minute("ts")
    )
    t = F.col("event_type")
    return e.select(
        F.col("user_id").alias("track_id"),
        frame.alias("frame"),
        "event_id",
        "event_type",
        F.when(t == "view", F.lit(0.0)).otherwise(x).alias("l"),
        F.when(t == "click", F.lit(0.0)).when(t == "signup", -x).when(t == "error", x / 2).otherwise(x).alias("r"),
    )


EV_SQL = """
ev AS (
  SELECT user_id AS track_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS frame,
         event_id, event_type,
         CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value / 100 END AS l,
         CASE WHEN event_type = 'click' THEN 0.0::DOUBLE WHEN event_type = 'signup' THEN -(value / 100)
              WHEN event_type = 'error' THEN value / 100 / 2 ELSE value / 100 END AS r
  FROM events)"""


def line_samples(spark: SparkSession, root: str) -> DataFrame:
    """Line items as a two-channel signal: one track per supplier, one frame per day."""
    li = table(spark, root, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("track_id"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("frame"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 50).alias("l"),
        (F.col("l_extendedprice") / 100000).alias("r"),
    )


LI_SQL = """
li AS (
  SELECT l_suppkey AS track_id,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS frame,
         l_orderkey, l_linenumber, l_quantity / 50 AS l, l_extendedprice / 100000 AS r
  FROM lineitem)"""

# Edges of the coarse frequency bands in Hz; the last one is open.
COARSE_EDGES = (0.0, 120.0, 200.0, 250.0, 300.0, 2000.0, 10000.0)


def window_bands(spark: SparkSession, root: str) -> DataFrame:
    """Band powers of quarter-year windows: the line number is the band."""
    s = line_samples(spark, root)
    return s.groupBy(
        "track_id", F.expr("frame div 91").alias("win"), (F.col("l_linenumber") - 1).alias("band")
    ).agg(
        F.sum(F.col("l") * F.col("l")).alias("p_ll"),
        F.sum(F.col("r") * F.col("r")).alias("p_rr"),
        F.sum(F.col("l") * F.col("r")).alias("p_lr"),
    )


WB_SQL = LI_SQL + """,
wb AS (
  SELECT track_id, frame // 91 AS win, l_linenumber - 1 AS band,
         sum(l * l) AS p_ll, sum(r * r) AS p_rr, sum(l * r) AS p_lr
  FROM li GROUP BY ALL)"""
