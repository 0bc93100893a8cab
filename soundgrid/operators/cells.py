"""Time cells: samples to fixed-width cells, cells to windows.

Everything starts with a partial aggregation on (track, cell), so a track that
holds most of the samples is combined on the map side and leaves behind no more
cells than its duration allows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(samples: DataFrame, keys: list[str], frame: str, width: int, aggs: dict[str, Column], cell: str = "cell") -> DataFrame:
    """One row per non-empty cell, with the true number of samples in it."""
    return samples.groupBy(*keys, F.expr(f"{frame} div {width}").alias(cell)).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )


def extents(samples: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Track length in frames: one past the last sample."""
    return samples.groupBy(*keys).agg((F.max(frame) + 1).alias("frames"))


def dense_cells(samples: DataFrame, keys: list[str], frame: str, width: int, sums: dict[str, Column], cell: str = "cell") -> DataFrame:
    """Every cell of every track; a cell without samples is silence.

    `n` is the number of frames the cell covers, so a partial last cell counts
    with its true length.
    """
    sparse = cells(samples, keys, frame, width, sums, cell)
    spine = extents(samples, keys, frame).select(
        *keys, "frames", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(frames - 1) div {width}"))).alias(cell)
    )
    return spine.join(sparse, [*keys, cell], "left").select(
        *keys,
        cell,
        F.least(F.lit(width).cast("bigint"), F.col("frames") - F.col(cell) * width).alias("n"),
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in sums],
    )


def overlapping_windows(samples: DataFrame, keys: list[str], frame: str, size: int, hop: int, sums: dict[str, Column]) -> DataFrame:
    """Windows of `size` frames every `hop`, complete ones plus one partial tail.

    The tail is kept only if it holds frames no complete window has seen. Samples
    are summed once into cells of the common divisor, and only the cells are
    copied into the windows that overlap there.
    """
    base = math.gcd(size, hop)
    parts = cells(samples, keys, frame, base, sums, "_c")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("_c") * base + base - size) / hop))
    last = F.floor(F.col("_c") * base / hop)
    spread = (
        parts.where(first <= last)
        .withColumn("win", F.explode(F.sequence(first, last)))
        .groupBy(*keys, "win")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    full = F.when(F.col("frames") >= size, F.floor((F.col("frames") - size) / hop) + 1).otherwise(F.lit(0).cast("bigint"))
    seen = F.when(F.col("full") > 0, (F.col("full") - 1) * hop + size).otherwise(F.lit(0))
    tail = (F.col("frames") > F.col("full") * hop) & (F.col("frames") > seen)
    spine = (
        extents(samples, keys, frame)
        .withColumn("full", full)
        .withColumn("last", F.col("full") - 1 + tail.cast("bigint"))
        .where("last >= 0")
        .withColumn("win", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
        .select(
            *keys,
            "win",
            (F.col("win") * hop).alias("start"),
            F.least(F.col("win") * hop + size, F.col("frames")).alias("end"),
            (F.col("win") >= F.col("full")).alias("partial"),
        )
    )
    return spine.join(spread, [*keys, "win"], "left").select(
        *keys, "win", "start", "end", "partial", *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in sums]
    )


def bin_spine(tracks: DataFrame, keys: list[str], length: str, width: int, out: str = "bin") -> DataFrame:
    """Every macro bin of every track, so that empty bins are kept."""
    return tracks.select(
        *keys, length, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({length} - 1) div {width}"))).alias(out)
    )
