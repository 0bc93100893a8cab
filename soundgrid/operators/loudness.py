"""Loudness timeline and gates over 100 ms energy cells."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundgrid.functions import quantiles, scalar
from soundgrid.operators.blocks import halo
from soundgrid.operators.cells import dense_cells
from soundgrid.session import materialise

MOMENTARY_HOPS = 4
SHORT_TERM_HOPS = 30


def timeline(samples: DataFrame, keys: list[str], hop: int, rows: int | None = None) -> DataFrame:
    """Momentary and short-term power at each hop, NULL where the window is not complete."""
    d = dense_cells(samples, keys, "frame", hop, {"energy": F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r"))}, "hop")
    return from_hops(d, keys, hop, rows)


def from_hops(d: DataFrame, keys: list[str], hop: int, rows: int | None = None) -> DataFrame:
    """The same from dense cells (hop, n, energy), e.g. K-weighted ones; a known number of them keeps tasks small."""
    h = halo(d, keys, "hop", 0, SHORT_TERM_HOPS - 1)
    h = h if rows is None else h.spread(rows)
    m, s = h.reach(0, MOMENTARY_HOPS - 1), h.reach(0, SHORT_TERM_HOPS - 1)
    h = h.with_columns({"_mn": F.sum("n").over(m), "_me": F.sum("energy").over(m), "_sn": F.sum("n").over(s), "_se": F.sum("energy").over(s)})
    return h.own().select(
        *keys,
        "hop",
        F.when(F.col("_mn") == MOMENTARY_HOPS * hop, F.col("_me") / (MOMENTARY_HOPS * hop)).alias("m_power"),
        F.when(F.col("_sn") == SHORT_TERM_HOPS * hop, F.col("_se") / (SHORT_TERM_HOPS * hop)).alias("s_power"),
    )


def gated_mean(blocks: DataFrame, keys: list[str], power: str, relative: float) -> DataFrame:
    """Two-stage gate: blocks above -70, then above the mean of those minus `relative`."""
    level = scalar.lufs(F.col(power))
    loud = blocks.where(level > scalar.ABSOLUTE_GATE_LUFS)
    first = loud.groupBy(*keys).agg(F.avg(power).alias("_mean"), F.count("*").alias("n_absolute"))
    second = loud.join(first, keys).where(level > scalar.lufs(F.col("_mean")) - relative)
    return second.groupBy(*keys).agg(
        F.first("n_absolute").alias("n_absolute"),
        F.count("*").alias("n_selected"),
        F.avg(power).alias("power"),
    )


def integrated(blocks: DataFrame, keys: list[str], power: str = "m_power") -> DataFrame:
    """Every track with at least one complete block; NULL loudness when nothing passes."""
    complete = blocks.where(F.col(power).isNotNull())
    counts = complete.groupBy(*keys).agg(F.count("*").alias("n_blocks"))
    return counts.join(gated_mean(complete, keys, power, scalar.RELATIVE_GATE_LU), keys, "left").select(
        *keys,
        "n_blocks",
        F.coalesce("n_absolute", F.lit(0)).cast("bigint").alias("n_absolute"),
        F.coalesce("n_selected", F.lit(0)).cast("bigint").alias("n_selected"),
        scalar.lufs(F.col("power")).alias("lufs"),
    )


def loudness_range(blocks: DataFrame, keys: list[str], power: str = "s_power") -> DataFrame:
    """Spread of the short-term loudness: gate at -70 and -20, nearest-rank P95 - P10."""
    level = scalar.lufs(F.col(power))
    loud = blocks.where(level > scalar.ABSOLUTE_GATE_LUFS)
    first = loud.groupBy(*keys).agg(F.avg(power).alias("_mean"))
    kept = materialise(loud.join(first, keys).where(level >= scalar.lufs(F.col("_mean")) - 20).select(*keys, level.alias("_l")))
    q = quantiles.grouped(kept, keys, {"p10": ("_l", 0.10, "nearest"), "p95": ("_l", 0.95, "nearest")})
    n = kept.groupBy(*keys).agg(F.count("*").alias("n"))
    return q.join(n, keys).withColumn("lra", F.col("p95") - F.col("p10"))


def regional(regions: DataFrame, readings: DataFrame, keys: list[str], region_keys: list[str], hop: int,
             power: str = "s_power", window_hops: int = SHORT_TERM_HOPS) -> DataFrame:
    """Lower-median loudness of the complete windows inside each region.

    Absent (no row) for regions shorter than a window, with fewer than three
    readings, or less than half of them valid. Windows are found through hop
    buckets, so only windows near a region meet it.
    """
    size = window_hops * hop
    bucket = 256
    want = (
        regions.withColumn("_lo", F.ceil(F.col("start") / hop))
        .withColumn("_hi", F.floor((F.col("end") - size) / hop))
        .where((F.col("end") - F.col("start") >= size) & (F.col("_hi") >= F.col("_lo")))
        .withColumn("_b", F.explode(F.sequence(F.expr(f"_lo div {bucket}"), F.expr(f"_hi div {bucket}"))))
    )
    have = readings.select(*keys, "hop", scalar.lufs(F.col(power)).alias("s_lufs"), F.expr(f"hop div {bucket}").alias("_b"))
    inside = want.join(have, [*keys, "_b"]).where("hop BETWEEN _lo AND _hi")
    g = [*keys, *region_keys]
    x = F.col("s_lufs")
    loud = x > scalar.ABSOLUTE_GATE_LUFS
    stats = inside.groupBy(*g).agg(
        F.count("*").alias("possible"),
        F.count("s_lufs").alias("valid"),
        F.avg(F.when(loud, scalar.power_from_lufs(x))).alias("_mean"),
    ).where("valid >= 3 AND valid * 2 >= possible")
    kept = inside.join(stats, g).where(loud & (x > scalar.lufs(F.col("_mean")) - 20))
    kept = materialise(kept.select(*g, "possible", "valid", "s_lufs"))
    n = kept.groupBy(*g, "possible", "valid").agg(F.count("*").alias("selected")).where("selected >= 3")
    return n.join(quantiles.grouped(kept, g, {"lufs": ("s_lufs", 0.5, "lower")}), g)
