"""Ordered recurrences along a track, computed block by block.

A follower forgets its past geometrically, so a block preceded by a warm-up of
known length gives the same doubles as one run over the whole track. No track is
gathered into one task.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.operators import kernels
from soundgrid.operators.blocks import halo


def coefficient(seconds: float, rate: float) -> float:
    return math.exp(-1.0 / (rate * max(seconds, 1e-5)))


def by_block(df: DataFrame, keys: list[str], pos: str, value: str, out: str, before: int, after: int, kernel, block: int = 4096) -> DataFrame:
    """kernel(values, starts_at_track_start) over each block with its halo; dense positions."""
    h = halo(df.select(*keys, pos, value), keys, pos, before, after, block)
    size = h.block
    schema = T.StructType([f for f in df.schema if f.name in (*keys, pos)] + [T.StructField(out, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        at = pdf[pos].to_numpy()
        y = kernel(pdf[value].to_numpy(dtype=float), at[0] == 0)
        own = at // size == pdf["_blk"].iloc[0]
        return pdf.loc[own, [*keys, pos]].assign(**{out: y[own]})

    return h.df.groupBy(*keys, "_blk").applyInPandas(run, schema)


def smooth_gain(df: DataFrame, keys: list[str], pos: str, value: str, rate: float, attack_s: float, release_s: float, out: str, block: int = 4096) -> DataFrame:
    """Attack/release smoothing of a gain that is already held over its look-ahead."""
    a, r = coefficient(attack_s, rate), coefficient(release_s, rate)
    w = kernels.warmup(max(attack_s, release_s), rate)
    return by_block(df, keys, pos, value, out, w, 0, lambda x, _: kernels.follow_down(x, a, r), block)


def ride_bands(df: DataFrame, keys: list[str], pos: str, values: str, rate: float, attack_s: float, release_s: float, out: str, block: int = 4096) -> DataFrame:
    """Corrections of all bands of a frame (one array), each engaging with `attack` and relaxing with `release`."""
    a, r = coefficient(attack_s, rate), coefficient(release_s, rate)
    h = halo(df.select(*keys, pos, values), keys, pos, kernels.warmup(max(attack_s, release_s), rate), 0, block)
    size = h.block
    schema = T.StructType([f for f in df.schema if f.name in (*keys, pos)] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        y = kernels.follow_size(np.stack(pdf[values].to_numpy()), a, r)
        own = pdf[pos].to_numpy() // size == pdf["_blk"].iloc[0]
        return pdf.loc[own, [*keys, pos]].assign(**{out: list(y[own])})

    return h.df.groupBy(*keys, "_blk").applyInPandas(run, schema)


def limiter(df: DataFrame, keys: list[str], pos: str, peak: str, threshold: float, attack: int, release: int, out: str, block: int = 4096) -> DataFrame:
    """Look-ahead limiter envelope from the peaks of dense cells."""
    w = kernels.warmup(release, 1.0) + 2 * attack
    return by_block(df, keys, pos, peak, out, w, attack, lambda x, _: kernels.limiter_envelope(x, threshold, attack, release), block)


def headroom(samples: DataFrame, keys: list[str], frame: str, magnitude: str, rate: float, attack_s: float = 0.06, release_s: float = 0.3) -> DataFrame:
    """Peak against the loudest sustained level, in dB.

    Sparse samples; the envelope's block runs start after a warm-up.
    """
    a, r = coefficient(attack_s, rate), coefficient(release_s, rate)
    w = kernels.warmup(max(attack_s, release_s), rate)
    d = samples.groupBy(*keys, frame).agg(F.max(magnitude).alias("_a"))
    h = halo(d, keys, frame, w, 0, block=64 * w)
    schema = T.StructType([f for f in samples.schema if f.name in keys] + [T.StructField("peak", T.DoubleType()), T.StructField("sustain", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        x = pdf["_a"].to_numpy()
        s = kernels.sustain_peak(pdf[frame].to_numpy(), x, a, r)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "peak": float(x.max()), "sustain": s}])

    g = h.df.groupBy(*keys, "_blk").applyInPandas(run, schema).groupBy(*keys).agg(F.max("peak").alias("peak"), F.max("sustain").alias("sustain"))
    ok = (F.col("peak") > 0) & (F.col("sustain") > 0)
    return g.withColumn("headroom_db", F.when(ok, F.greatest(F.lit(0.0), 20 * F.log10(F.col("peak") / F.col("sustain")))).otherwise(0.0))
