"""Onsets: picking, durations, attack refinement, lag pairs and tempo."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundgrid.operators.blocks import halo
from soundgrid.operators.joins import range_join
from soundgrid.operators.windows import greedy_gap
from soundgrid.session import materialise


def refine_attacks(onsets: DataFrame, power: DataFrame, lengths: DataFrame, keys: list[str], onset_keys: list[str], window: int, radius: int) -> DataFrame:
    """Move an onset to the strongest rise of the power after over the power before.

    Each sample adds to the rises of the frames just before it and takes from
    those just after, so the rise curve is a scatter and a sum. Only samples in a
    bucket that an onset reaches are scattered.
    """
    wide = 4 * (radius + window)
    reach = F.sequence(F.floor((F.col("detected") - radius - window) / wide), F.floor((F.col("detected") + radius + window) / wide))
    near = onsets.select(*keys, F.explode(reach).alias("_near")).distinct()
    power = power.withColumn("_near", F.floor(F.col("frame") / wide)).join(near, [*keys, "_near"], "left_semi")
    j = F.sequence(F.lit(0), F.lit(window - 1))
    up = power.select(*keys, "frame", "p", F.explode(j).alias("_j")).select(*keys, (F.col("frame") - F.col("_j")).alias("f"), "p")
    down = power.select(*keys, "frame", "p", F.explode(j).alias("_j")).select(*keys, (F.col("frame") + 1 + F.col("_j")).alias("f"), (-F.col("p")).alias("p"))
    rises = up.unionByName(down).groupBy(*keys, "f").agg(F.sum("p").alias("rise")).where("rise > 0")
    o = onsets.join(lengths, keys).withColumns({
        "_lo": F.greatest(F.lit(window), F.col("detected") - radius),
        "_hi": F.least(F.col("frames") - window, F.col("detected") + radius) - 1,
    })
    hit = range_join(o, rises, keys, "_lo", "_hi", "f", 4 * radius)
    best = hit.groupBy(*keys, *onset_keys).agg(F.max_by("f", F.struct(F.col("rise"), -F.col("f"))).alias("_f"))
    attack = F.when(F.col("_f").isNull(), F.least("frames", "detected")).otherwise(F.greatest(F.lit(0), F.least(F.col("detected"), F.col("_f") - window)))
    return o.join(best, [*keys, *onset_keys], "left").select(*keys, *onset_keys, "detected", attack.alias("attack"))


def punch_weight(points: DataFrame, onsets: DataFrame, keys: list[str], pos: str, onset: str, rise: int, hold: int, fall: int) -> DataFrame:
    """Largest cosine-edged weight of the onsets that reach each point."""
    o = onsets.withColumns({"_lo": F.col(onset) - rise, "_hi": F.col(onset) + hold + fall})
    hit = range_join(o, points.select(*keys, pos).distinct(), keys, "_lo", "_hi", pos, 4 * (rise + hold + fall))
    d = F.col(pos) - F.col(onset)
    w = F.when(d < 0, 0.5 - 0.5 * F.cos(math.pi * (d + rise) / rise)).when(d <= hold, 1.0).otherwise(0.5 + 0.5 * F.cos(math.pi * (d - hold) / fall))
    best = hit.groupBy(*keys, pos).agg(F.max(w).alias("weight"))
    return points.join(best, [*keys, pos], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def energy_flux(samples: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rise of the cell magnitude over the cell before, relative to the track's largest.

    Sparse: a cell that does not rise has no row and stands for zero.
    """
    l, r = F.col("l"), F.col("r")
    c = samples.groupBy(*keys, F.expr(f"frame div {width}").alias("cell")).agg(F.sqrt(F.sum(l * l + r * r)).alias("m"))
    h = halo(c, keys, "cell", 1, 0)
    before = F.coalesce(F.max("m").over(h.window.rangeBetween(-1, -1)), F.lit(0.0))
    flux = materialise(h.with_columns({"flux": F.greatest(F.lit(0.0), F.col("m") - before)}).own().where("flux > 0").select(*keys, "cell", "flux"))
    top = flux.groupBy(*keys).agg(F.max("flux").alias("_top"))
    return flux.join(top, keys).select(*keys, "cell", (F.col("flux") / F.col("_top")).alias("novelty"))


def pick(novelty: DataFrame, lengths: DataFrame, keys: list[str], radius: int, gap: int, margin: float = 0.06) -> DataFrame:
    """Local maxima above the mean around them plus a margin, at least `gap` apart.

    `lengths` gives the number of cells of a track; its first and last never count.
    """
    h = halo(novelty, keys, "cell", radius, radius)
    v, i, n = F.col("novelty"), F.col("cell"), F.col("cells")
    zero = F.lit(0.0)
    h = h.with_columns({
        "_prev": F.coalesce(F.max(v).over(h.window.rangeBetween(-1, -1)), zero),
        "_next": F.coalesce(F.max(v).over(h.window.rangeBetween(1, 1)), zero),
        "_sum": F.sum(v).over(h.reach(radius, radius)),
    })
    width = F.least(n - 1, i + radius) - F.greatest(F.lit(0), i - radius) + 1
    ok = (i >= 1) & (i <= n - 2) & (v >= F.col("_prev")) & (v >= F.col("_next")) & (v >= F.col("_sum") / width + margin)
    c = materialise(h.own().join(lengths, keys).where(ok).select(*keys, "cell", F.col("novelty").alias("strength"), "cells"))
    return c.join(greedy_gap(c, keys, "cell", gap), [*keys, "cell"])


def durations(onsets: DataFrame, novelty: DataFrame, keys: list[str], limit: int, drop: float = 0.35) -> DataFrame:
    """Cells until the novelty has fallen to `drop` of the onset, at most `limit`."""
    ahead = (
        onsets.select(*keys, "cell", "strength", "cells", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("_j"))
        .withColumn("_at", F.col("cell") + F.col("_j")).where("_at < cells")
        .join(novelty.select(*keys, F.col("cell").alias("_at"), "novelty"), [*keys, "_at"], "left")
    )
    low = F.coalesce("novelty", F.lit(0.0)) <= drop * F.col("strength")
    ends = ahead.groupBy(*keys, "cell").agg(F.coalesce(F.min(F.when(low, F.col("_j"))), F.max("_j")).alias("length"))
    return onsets.join(ends, [*keys, "cell"], "left").withColumn("length", F.coalesce("length", F.lit(0)))


# --- tempo ------------------------------------------------------------------

# Fixed values of the tempo estimate: seconds and beats per minute.
BIN_SEC, MAX_LAG_SEC, KERNEL_SEC = 0.005, 2.05, 0.025
MIN_BPM, MAX_BPM, BPM_STEP = 60.0, 200.0, 0.25
RELIABLE = 0.25
GRID = int((MAX_BPM - MIN_BPM) / BPM_STEP) + 1
# Weights of the beat period and of its double, half and one and a half.
PERIOD_WEIGHTS = ((1.0, 1.0), (2.0, 0.5), (0.5, 0.1), (1.5, 0.1))


def lag_histogram(onsets: DataFrame, keys: list[str]) -> DataFrame:
    """Salience of the onset lags up to 2.05 s in 5 ms bins, with the pair count.

    Partners meet through time buckets of the longest lag. Onsets keep a minimum
    gap, so an onset has a bounded number of partners however long the track is.
    """
    s = F.greatest(F.lit(0.05), F.col("strength"))
    a = onsets.select(*keys, F.col("t").alias("t0"), s.alias("s0"), F.floor(F.col("t") / MAX_LAG_SEC).alias("_k"))
    b = onsets.select(*keys, F.col("t").alias("t1"), s.alias("s1"), F.floor(F.col("t") / MAX_LAG_SEC).alias("_k"))
    left = a.withColumn("_k", F.explode(F.array(F.col("_k"), F.col("_k") + 1)))
    pairs = left.join(b, [*keys, "_k"]).withColumn("lag", F.col("t1") - F.col("t0")).where((F.col("lag") > 0) & (F.col("lag") <= MAX_LAG_SEC))
    return pairs.groupBy(*keys, F.floor(F.col("lag") / BIN_SEC + 0.5).alias("bin")).agg(
        F.sum(F.col("s0") * F.col("s1")).alias("salience"), F.count("*").alias("pairs"))


def tempo_scores(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Support and prior-weighted score of every candidate tempo a lag bin reaches.

    A bin is sent only to the candidates whose kernel covers it; nothing meets the
    whole grid. The bins of a key, a few hundred at most, come together first, so that
    the rows per candidate are summed where they arise.
    """
    hist = hist.repartition(*keys)
    lag = F.col("bin") * BIN_SEC
    top = F.lit(GRID - 1).cast("bigint")
    d = hist.where("bin >= 1").select(*keys, "bin", "salience", F.explode(F.array(*[F.struct(F.lit(m).alias("k"), F.lit(w).alias("w")) for m, w in PERIOD_WEIGHTS])).alias("_p"))
    k = F.col("_p.k")
    # period * multiple within the kernel around the lag  ->  a range of tempi
    slow = F.greatest(F.lit(MIN_BPM), 60 * k / (lag + KERNEL_SEC))
    fast = F.least(F.lit(MAX_BPM), 60 * k / F.greatest(F.lit(1e-9), lag - KERNEL_SEC))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((slow - MIN_BPM) / BPM_STEP))
    last = F.least(top, F.ceil((fast - MIN_BPM) / BPM_STEP))
    d = d.where(slow <= fast).withColumn("cand", F.explode(F.sequence(first, F.greatest(first, last))))
    period = F.col("_p.k") * 60 / (MIN_BPM + F.col("cand") * BPM_STEP)
    w = F.greatest(F.lit(0.0), 1 - F.abs(lag - period) / KERNEL_SEC)
    u = d.where(period <= MAX_LAG_SEC).select(*keys, "cand", (F.col("_p.w") * F.col("salience") * w).alias("s"))
    bpm = MIN_BPM + F.col("cand") * BPM_STEP
    octave = F.log(bpm / 120.0) / math.log(2.0)
    return (
        u.groupBy(*keys, "cand").agg(F.sum("s").alias("support"))
        .withColumn("bpm", bpm)
        .withColumn("score", F.col("support") * F.exp(-0.5 * octave * octave))
    )




def _support(bpm: Column) -> Column:
    """Contribution of one lag bin to the rhythmic support of a tempo."""
    lag = F.col("bin") * BIN_SEC
    total = F.lit(0.0)
    for mult, weight in PERIOD_WEIGHTS:
        period = mult * 60 / bpm
        total = total + F.when(
            (period <= MAX_LAG_SEC) & (F.col("bin") >= 1), weight * F.greatest(F.lit(0.0), 1 - F.abs(lag - period) / KERNEL_SEC)
        ).otherwise(F.lit(0.0))
    return F.col("salience") * total


def estimate(onsets: DataFrame, keys: list[str]) -> DataFrame:
    """Tempo and confidence per key; (0, 0) is unknown.

    Onsets come as (keys, t, strength) with t in seconds.
    """
    hist = materialise(lag_histogram(onsets, keys))
    span = onsets.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    pairs = hist.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
    scores = tempo_scores(hist, keys).groupBy(*keys).agg(
        F.max_by(F.struct("bpm", "score"), F.struct(F.col("score"), -F.col("cand"))).alias("best"),
        F.array_sort(F.collect_list("score")).alias("all"),  # at most one per grid tempo
    )
    zeros = GRID - F.size("all")
    middle = F.when(F.lit(GRID // 2) < zeros, 0.0).otherwise(F.try_element_at("all", (F.lit(GRID // 2) - zeros + 1).cast("int")))
    s = scores.select(*keys, F.col("best.bpm").alias("bpm"), F.col("best.score").alias("score"), middle.alias("median"))
    bpm = F.col("bpm")
    alt = hist.join(s.select(*keys, "bpm"), keys).groupBy(*keys).agg(
        F.sum(_support(bpm)).alias("own"), F.sum(_support(bpm / 2)).alias("half"), F.sum(_support(bpm * 2)).alias("double"))
    d = span.join(pairs, keys, "left").join(s, keys, "left").join(alt, keys, "left")
    prominence = F.col("score") / F.greatest(F.col("median"), 0.02 * F.col("score"))
    known = (F.col("n") >= 8) & (F.col("span") >= 4) & (F.col("pairs") >= 40) & (F.col("score") > 0) & (prominence >= 2)
    octave = F.greatest(F.when(bpm / 2 >= MIN_BPM, F.col("half")).otherwise(0.0), F.when(bpm * 2 <= MAX_BPM, F.col("double")).otherwise(0.0))
    conf = F.least(F.lit(1.0), (prominence - 1) / 4)
    conf = F.when(octave >= 0.85 * F.col("own"), F.least(conf, F.lit(0.65))).otherwise(conf)
    return d.select(
        *keys, "n", "span",
        F.when(known, bpm).otherwise(0.0).alias("bpm"),
        F.when(known, conf).otherwise(0.0).alias("confidence"),
    )


def tempo(onsets: DataFrame, keys: list[str]) -> DataFrame:
    """Tempo of the whole track, checked against its two halves where they are long enough."""
    on = materialise(onsets.select(*keys, "t", "strength"))
    whole = materialise(estimate(on, keys))
    mid = on.groupBy(*keys).agg(((F.min("t") + F.max("t")) * 0.5).alias("mid"))
    long_enough = whole.where((F.col("confidence") >= RELIABLE) & (F.col("n") >= 48) & (F.col("span") >= 16)).select(*keys)
    halves = on.join(long_enough, keys).join(mid, keys).withColumn("part", F.when(F.col("t") < F.col("mid"), 1).otherwise(2))
    h = estimate(halves.select(*keys, "part", "t", "strength"), [*keys, "part"])
    pivot = h.groupBy(*keys).agg(*[
        F.max(F.when(F.col("part") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("n", "bpm", "confidence")])
    d = whole.join(pivot, keys, "left")
    usable = F.coalesce((F.col("n1") >= 16) & (F.col("n2") >= 16), F.lit(False))
    weak = (F.col("confidence1") < RELIABLE) | (F.col("confidence2") < RELIABLE)
    ratio = F.col("bpm1") / F.col("bpm2")
    verdict = (
        F.when(~usable, "whole").when(weak, "weak_half").when(F.abs(ratio - 1) < 0.03, "whole")
        .when((F.abs(ratio - 2) < 0.06) | (F.abs(ratio - 0.5) < 0.015), "octave").otherwise("conflict")
    )
    d = d.withColumn("verdict", verdict)
    factor = F.when(F.col("verdict") == "weak_half", 0.8).when(F.col("verdict") == "octave", 0.65).when(F.col("verdict") == "conflict", 0.0).otherwise(1.0)
    return d.select(
        *keys, "n", "verdict", F.when(F.col("verdict") == "conflict", 0.0).otherwise(F.col("bpm")).alias("bpm"),
        (F.col("confidence") * factor).alias("confidence"))
