"""Corpus study: window bands to recording features, recordings to group statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundgrid.functions import quantiles, scalar
from soundgrid.functions.quantiles import order_statistics
from soundgrid.session import materialise

COMPONENTS = ("stereo", "left", "right", "mid", "side")


def component(name: str) -> Column:
    ll, rr, lr = F.col("p_ll"), F.col("p_rr"), F.col("p_lr")
    return {"stereo": (ll + rr) / 2, "left": ll, "right": rr, "mid": scalar.mid_power(ll, rr, lr), "side": scalar.side_power(ll, rr, lr)}[name]


def impossible(ll: Column, rr: Column, lr: Column) -> Column:
    """Negative power, or a cross power beyond the Cauchy-Schwarz bound."""
    return (ll < 0) | (rr < 0) | (F.abs(lr) > F.sqrt(ll * rr) + (ll + rr) * 1e-12)


def dense_bands(bands: DataFrame, keys: list[str], n_bands: int) -> DataFrame:
    """Every band of every window: a band without samples has no power."""
    spine = bands.select(*keys, "win").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))))
    d = spine.join(bands, [*keys, "win", "band"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p_ll", "p_rr", "p_lr")})


def active_windows(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Window totals above max(1e-8, P95 * 1e-4) of their track."""
    totals = bands.groupBy(*keys, "win").agg(F.sum((F.col("p_ll") + F.col("p_rr")) / 2).alias("total"))
    totals = materialise(totals)
    gate = quantiles.grouped(totals, keys, {"_p": ("total", 0.95, "linear")}).select(*keys, F.greatest(F.lit(1e-8), F.col("_p") * 1e-4).alias("gate"))
    return totals.join(gate, keys).where("total >= gate")


def pooled(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Mean mid and side power per band over all windows of a track, with their fractions."""
    windows = bands.groupBy(*keys).agg(F.count_distinct("win").alias("windows"))
    g = bands.groupBy(*keys, "band").agg(*[F.sum(c).alias(c) for c in ("p_ll", "p_rr", "p_lr")]).join(windows, keys)
    g = g.withColumns({c: F.col(c) / F.col("windows") for c in ("p_ll", "p_rr", "p_lr")})
    g = g.withColumns({"mid": component("mid"), "side": component("side")})
    t = g.groupBy(*keys).agg(F.sum("mid").alias("total_mid"), F.sum("side").alias("total_side"))
    share = {f"{x}_fraction": F.when(F.col(f"total_{x}") > 0, F.col(x) / F.col(f"total_{x}")) for x in ("mid", "side")}
    return g.join(t, keys).withColumns(share)


def group_summary(recordings: DataFrame, group: str, value: str, accepted: str = "accepted") -> DataFrame:
    """Number, mean, quantiles and extremes per group over accepted recordings.

    Each recording counts once. Groups may hold any share of the corpus, so the
    quantiles are exact order statistics that gather no group.
    """
    cover = recordings.groupBy(group).agg(
        F.count("*").alias("expected"), F.sum(F.col(accepted).cast("bigint")).alias("accepted"))
    ok = recordings.where(F.col(accepted) & F.col(value).isNotNull() & ~F.isnan(value))
    stats = ok.groupBy(group).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = order_statistics(ok, [group], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return cover.join(stats, group, "left").join(q, group, "left").withColumn(
        "coverage_complete", (F.col("accepted") == F.col("expected")) & (F.col("expected") >= 5))


def genre_profile(recordings: DataFrame, group: str, share: str) -> DataFrame:
    """Mean side share with equal weight per recording."""
    return recordings.where(F.col(share).isNotNull()).groupBy(group).agg(
        F.count("*").alias("references"), F.avg(share).alias("target_side"), F.min(share).alias("minimum_side"), F.max(share).alias("maximum_side"))


def difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each table, and rows that only one of them has."""

    parts = {"rows_a": a, "rows_b": b, "only_a": a.exceptAll(b), "only_b": b.exceptAll(a)}
    counts = None
    for name, df in parts.items():
        c = df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    return counts.agg(*[F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])
