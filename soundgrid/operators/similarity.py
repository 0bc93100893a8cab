"""Similarity of cells, segments and sketches."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.operators import kernels

POWER_DOUBLING_DB = 3.01


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def tone_distance(a: Column, b: Column, rotation: int = 0) -> Column:
    """Half L1 of two 36-bin distributions; a rotation is a semitone, three bins."""
    k = 3 * rotation
    rotated = F.concat(F.slice(b, k + 1, 36 - k), F.slice(b, 1, k)) if k else b
    return 0.5 * _fold(F.zip_with(a, rotated, lambda x, y: F.abs(x - y)))


def timbre_distance(shape_a: Column, shape_b: Column, contrast_a: Column, contrast_b: Column) -> Column:
    """1 - exp(-d2 / (2 * 3.01^2)), bands weighted by the louder of the two."""
    lin = lambda s: F.transform(s, lambda x: F.pow(F.lit(10.0), x / 10))
    w = F.zip_with(lin(shape_a), lin(shape_b), lambda x, y: F.greatest(x, y))
    d2 = F.zip_with(
        F.zip_with(shape_a, shape_b, lambda x, y: (x - y) * (x - y)), F.zip_with(contrast_a, contrast_b, lambda x, y: (x - y) * (x - y)), lambda x, y: x + y)
    squared = 0.5 * _fold(F.zip_with(w, d2, lambda x, y: x * y)) / _fold(w)
    return 1 - F.exp(-squared / (2 * POWER_DOUBLING_DB**2))


def gated_tone(valid_a: Column, valid_b: Column, distance: Column) -> Column:
    """Distance when both are tonal, 1 when only one is, 0 when neither."""
    return F.when(valid_a & valid_b, distance).when(valid_a | valid_b, 1.0).otherwise(0.0)


def cell_distance(short: Column, long: Column, timbre: Column, usable: Column) -> tuple[Column, Column]:
    """Tone (the worse of short and long) and timbre; 1 for an invalid pair."""
    return F.when(usable, F.greatest(short, long)).otherwise(1.0), F.when(usable, timbre).otherwise(1.0)


def best_rotation(bins: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Best of the twelve chroma rotations by mean cosine, and the share of bins that agree.

    One row per pair and bin in; twelve rotations are a fixed fan-out. Earlier
    rotations win ties.
    """
    rot = bins.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(11))))
    turned = F.concat(F.slice(b, F.col("rotation") + 1, 12 - F.col("rotation")), F.when(F.col("rotation") > 0, F.slice(b, F.lit(1), F.col("rotation"))).otherwise(F.array().cast("array<double>")))
    na, nb = F.sqrt(_fold(F.transform(a, lambda x: x * x))), F.sqrt(_fold(F.transform(b, lambda x: x * x)))
    cos = F.when((na <= 1e-12) | (nb <= 1e-12), 0.0).otherwise(_fold(F.zip_with(a, turned, lambda x, y: x * y)) / (na * nb))
    rot = rot.select(*keys, "bin", "rotation", cos.alias("cos"))
    means = rot.groupBy(*keys, "rotation").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cos")))).alias("mean"))
    best = means.groupBy(*keys).agg(F.max_by(F.struct("rotation", "mean"), F.struct(F.round("mean", 12), -F.col("rotation"))).alias("_b"))
    top = rot.groupBy(*keys, "bin").agg(F.max("cos").alias("_top"))
    chosen = rot.join(best.select(*keys, F.col("_b.rotation").alias("rotation"), F.col("_b.mean").alias("mean")), [*keys, "rotation"]).join(top, [*keys, "bin"])
    return chosen.groupBy(*keys, "rotation", "mean").agg(
        F.count("*").alias("bins"), F.sum((F.col("cos") >= F.col("_top") - 1e-12).cast("bigint")).alias("support"))


def sketch_match(pairs: DataFrame, keys: list[str], a: str, b: str, bins: int, min_overlap: float = 0.99, max_lag: int = 4) -> DataFrame:
    """Best lag of two waveform sketches, its least-squares gain and relative residual.

    Sums of squares and products per lag; the smallest residual, then the shorter
    lag, then the negative one.
    """
    lags = [k for k in range(-max_lag, max_lag + 1) if (bins - abs(k)) / bins >= min_overlap]
    d = pairs.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    n = bins - F.abs("lag")
    x = F.slice(a, F.greatest(F.lit(1), 1 - F.col("lag")), n)
    y = F.slice(b, F.greatest(F.lit(1), 1 + F.col("lag")), n)
    d = d.withColumns({
        "_sx": _fold(F.transform(x, lambda v: v * v)) / n, "_sy": _fold(F.transform(y, lambda v: v * v)) / n,
        "_sxy": _fold(F.zip_with(x, y, lambda v, w: v * w)) / n})
    ok = (F.sqrt("_sx") > 1e-12) & (F.sqrt("_sy") > 1e-12) & (F.col("_sxy") / F.col("_sy") > 0)
    d = d.where(ok).withColumn("alpha", F.col("_sxy") / F.col("_sy"))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("_sx") - F.col("_sxy") * F.col("alpha")))
    d = d.withColumn("residual", rest / F.greatest(F.sqrt("_sx"), F.col("alpha") * F.sqrt("_sy"), F.lit(1e-12)))
    return d.groupBy(*keys).agg(
        F.min_by(F.struct("lag", "alpha", "residual"), F.struct(F.round("residual", 12), F.abs("lag"), F.col("lag"))).alias("_m")).select(
        *keys, "_m.lag", "_m.alpha", "_m.residual")


def mutual_best(pairs: DataFrame, keys: list[str], score: str, margin: float, tie: float = 1e-12) -> DataFrame:
    """Pairs that are each other's best without a tie, ahead of both second bests.

    Pairs come once (a < b); each end ranks its partners.
    """
    both = pairs.select(*keys, F.col("a").alias("x"), F.col("b").alias("y"), score).unionByName(
        pairs.select(*keys, F.col("b").alias("x"), F.col("a").alias("y"), score))
    w = Window.partitionBy(*keys, "x").orderBy(F.col(score).desc(), "y")  # at most 63 partners
    ranked = both.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_r = 1")
    ranked = ranked.select(*keys, "x", "y", score, F.coalesce("_next", F.lit(0.0)).alias("second"))
    tied = F.abs(F.col(score) - F.col("second")) <= tie
    r = ranked.where(~tied)
    back = r.select(*keys, F.col("x").alias("y"), F.col("y").alias("x"), F.col("second").alias("second_b"))
    d = r.join(back, [*keys, "x", "y"]).where("x < y")
    return d.withColumn("margin", F.least(F.col(score) - F.col("second"), F.col(score) - F.col("second_b"))).where(F.col("margin") >= margin).select(
        *keys, F.col("x").alias("a"), F.col("y").alias("b"), score, "margin")


SCORE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("harmonic", "timbre", "alignment", "combined")]
    + [T.StructField("rotation", T.IntegerType()), T.StructField("valid_bins", T.IntegerType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(SCORE)
def segment_score(a: pd.Series, b: pd.Series, ratio: pd.Series) -> pd.DataFrame:
    """Harmonic, timbral and aligned similarity of two segments given as 32 bins of
    twelve chroma values, eight shape values and activity (flat arrays)."""
    rows = [kernels.compare_bins(np.asarray(x), np.asarray(y), r) for x, y, r in zip(a, b, ratio)]
    return pd.DataFrame(rows, columns=SCORE.names)
