"""Half-open frame intervals: merge, crop, delete, re-clock, feathered weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundgrid.functions.scalar import smoothstep
from soundgrid.operators.blocks import running
from soundgrid.operators.joins import asof
from soundgrid.session import materialise

MAX_REGIONS = 256


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int = 1 << 16) -> DataFrame:
    """Union of overlapping or touching intervals.

    An interval opens a new region when it starts after everything before it has
    ended; the region is named by the start of its opener.
    """
    # One row per start first: equal starts need no order among themselves.
    d = materialise(df.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end)))
    d = running(d, keys, start, {"_reach": ("max", F.col(end))}, before_only=True, block=block)
    opener = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    d = running(d, keys, start, {"_open": ("max", opener)}, block=block)
    return d.groupBy(*keys, F.col("_open").alias(start)).agg(F.max(end).alias(end))


def within_limit(regions: DataFrame, keys: list[str], limit: int = MAX_REGIONS) -> DataFrame:
    """Region count per key and whether the reference limit allows it."""
    return regions.groupBy(*keys).agg(F.count("*").alias("regions")).withColumn("allowed", F.col("regions") <= limit)


def crop(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Intersect with [lo, hi) and re-base to its start."""
    a, b = F.greatest(lo, F.col("start")), F.least(hi, F.col("end"))
    d = df.withColumns({"_a": a, "_b": b}).where("_b > _a")
    return merge(d.select(*keys, (F.col("_a") - lo).alias("start"), (F.col("_b") - lo).alias("end")), keys)


def delete(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Remove [lo, hi) and close the gap."""

    def shift(x: Column) -> Column:
        return F.when(x <= lo, x).otherwise(F.greatest(lo, x - (hi - lo)))

    d = df.withColumns({"_a": shift(F.col("start")), "_b": shift(F.col("end"))}).where("_b > _a")
    return merge(d.select(*keys, F.col("_a").alias("start"), F.col("_b").alias("end")), keys)


def reclock(df: DataFrame, keys: list[str], source_rate: int, rate: int) -> DataFrame:
    """Move to another sample rate; an interval keeps at least one frame."""

    def at(c: str) -> Column:
        return F.floor(F.col(c) * F.lit(float(rate)) / source_rate + 0.5)

    d = df.select(*keys, at("start").alias("start"), F.greatest(at("start") + 1, at("end")).alias("end"))
    return merge(d, keys)


def exclusion_weight(points: DataFrame, regions: DataFrame, keys: list[str], pos: str, feather: float, guard: float, out: str) -> DataFrame:
    """0 inside a region, rising by smoothstep with the distance outside it."""
    marks = regions.select(*keys, "start", F.struct("start", "end").alias("_iv"))
    d = asof(points, marks, keys, pos, "start", "_iv", "_before", "_after")
    p = F.col(pos)
    inside = F.coalesce(p < F.col("_before.end"), F.lit(False)) | F.coalesce(p == F.col("_after.start"), F.lit(False))
    distance = F.least(p - F.col("_before.end"), F.col("_after.start") - p)
    t = F.when(distance.isNull(), 1.0).otherwise((distance - guard) / max(1.0, feather))
    return d.withColumn(out, F.when(inside, 0.0).otherwise(smoothstep(t))).drop("_before", "_after")


def segments(boundaries: DataFrame, lengths: DataFrame, keys: list[str], pos: str, length: str) -> DataFrame:
    """Boundaries to contiguous segments that cover the track."""
    from soundgrid.operators.blocks import previous_row

    ends = boundaries.select(*keys, F.col(pos).alias("end")).unionByName(lengths.select(*keys, F.col(length).alias("end"))).distinct()
    d = previous_row(ends, keys, "end", {"start": "end"}, block=1 << 16)
    return d.select(*keys, F.coalesce("start", F.lit(0)).alias("start"), "end").where("end > start")
