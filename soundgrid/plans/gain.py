"""Gain plans: side level and guard, macro levelling, ramps, tone correction, safety."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.functions import quantiles, scalar
from soundgrid.operators import kernels, peaks, windows
from soundgrid.operators.blocks import halo, previous_row, running
from soundgrid.session import materialise

PER_DB = math.log(10) / 20


def side_plan(cells: DataFrame, keys: list[str], step: float, *, target: float | None = None, amount: float = 1.0, margin_db: float = 0.0) -> DataFrame:
    """Level and guard (natural log gains of the side signal) for dense mid/side cells.

    Every stage reaches a fixed number of cells, so one halo carries all of them:
    0.2 s means, triangular smoothing, 40 ms guard windows, and the slew limits,
    whose reach ends where 60 dB have been climbed.
    """
    r1, r2, win = (max(1, math.floor(x / step + 0.5)) for x in (0.2, 0.5, 0.04))
    rise, attack = 20 * step * PER_DB, 60 * step * PER_DB
    up, down = math.ceil(60 / (20 * step)) + 1, math.ceil(60 / (60 * step)) + 1
    reach = r1 + 2 * r2 + 2 * win + 1
    cells = materialise(cells.select(*keys, "cell", "m", "s"))
    t = cells.groupBy(*keys).agg(F.sum("m").alias("_pm"), F.sum("s").alias("_ps"), F.count("*").alias("_n"))
    observed = scalar.energy_share(F.col("_pm"), F.col("_ps"))
    goal = F.lit(target) if target is not None else F.coalesce(observed, F.lit(0.12))
    t = t.withColumns({"observed": observed, "target": scalar.clamp(goal, 0.001, 0.49), "_gate": F.greatest(F.lit(1e-14), (F.col("_pm") + F.col("_ps")) / F.col("_n") * 1e-6)})
    h = halo(cells.join(t, keys), keys, "cell", reach + up, reach + down).spread(cells.count())
    ratio = F.col("target") / (1 - F.col("target"))
    h = h.with_columns({"_mm": F.avg("m").over(h.reach(r1, r1)), "_ss": F.avg("s").over(h.reach(r1, r1))})
    ideal = 0.5 * (F.log(ratio) + F.log("_mm") - F.log("_ss"))
    on = (F.col("_mm") > F.col("_gate")) & (F.col("_ss") > F.col("_gate"))
    bounded = scalar.clamp(ideal, -24 * PER_DB, 12 * PER_DB)
    h = h.with_columns({"_l": F.when(on, amount * bounded).otherwise(0.0), "limited": F.coalesce(on & (F.abs(ideal - bounded) > 0.001), F.lit(False))})
    h = h.with_columns({"_l1": F.avg("_l").over(h.reach(r2, r2))})
    h = h.with_columns({"level": F.avg("_l1").over(h.reach(r2, r2))})
    ahead = h.window.rangeBetween(0, win - 1)
    h = h.with_columns({"_wm": F.sum("m").over(ahead), "_ws": F.sum("s").over(ahead), "_wn": F.count("*").over(ahead), "_wl": F.max("level").over(h.window.rangeBetween(0, win))})
    ceiling = ratio * 10 ** (margin_db / 10)
    safe = 0.5 * F.log(F.greatest(F.lit(1e-30), ceiling * F.col("_wm")) / F.col("_ws")) - F.col("_wl")
    need = F.when(F.col("_ws") > F.col("_gate") * F.col("_wn"), F.least(F.lit(0.0), F.greatest(F.lit(-60 * PER_DB), safe))).otherwise(0.0)
    h = h.with_columns({"_need": need})
    i = F.col("cell")
    h = h.with_columns({"_g": F.least(F.lit(0.0), F.min("_need").over(h.window.rangeBetween(-win, 0)))})
    # Running minima: rows of the block beyond the reach of a climb lie above -60 dB and never bind.
    so_far = (Window.unboundedPreceding, 0)
    h = h.with_columns({"_up": F.min(F.col("_g") - rise * i).over(h.window.rowsBetween(*so_far)) + rise * i})
    back = Window.partitionBy(*keys, "_blk").orderBy(F.desc("cell")).rowsBetween(*so_far)
    h = h.with_columns({"guard": F.min(F.col("_up") + attack * i).over(back) - attack * i})
    return h.own().select(*keys, "cell", "m", "s", "level", "guard", "limited", "target", "observed", "_pm", "_ps", "_gate", "_n")


def side_report(plan: DataFrame, keys: list[str], gain_db: float = 0.0) -> DataFrame:
    """Target, observed and estimated share per track, with the notice to show."""
    post = F.sum(F.col("s") * F.exp(2 * (F.col("level") + F.col("guard")))) * 10 ** (gain_db / 10)
    g = plan.groupBy(*keys, "target", "observed", "_pm", "_ps", "_gate", "_n").agg(post.alias("_post"), F.max("limited").alias("limited"))
    pm, ps, gate = F.col("_pm"), F.col("_ps"), F.col("_gate") * F.col("_n")
    notice = F.when(pm + ps == 0, "silence").when(pm <= gate, "mid_absent").when(ps <= gate, "no_usable_side").when(F.col("limited"), "range_limited").otherwise("")
    return g.select(*keys, "target", "observed", scalar.energy_share(pm, F.col("_post")).alias("estimated"), notice.alias("notice"))


def macro_curve(hops: DataFrame, edges: DataFrame, keys: list[str], rate: int, hop: int, amount: float = 1.0, speed: float = 0.5) -> DataFrame:
    """Macro levelling gains at every hop edge (one more point than hops).

    `hops` is dense (hop, energy, n, peak); `edges` are abrupt level changes the
    estimation must not cross. All but the energy bound are windows; the bound
    only concerns runs of windows that exceed it, and each run is folded alone.
    """
    wide = max(1, round(3.0 * rate / hop))
    radius = max(1, math.floor(6 * (1 / 3) ** speed * 0.5 * rate / hop + 0.5))
    soft = max(1, math.floor(0.5 * 1.2 * (1 / 6) ** speed * rate / hop + 0.5))
    hops = materialise(hops.select(*keys, "hop", "energy", "n", "peak").withColumn("power", F.col("energy") / F.col("n")))
    f = hops.groupBy(*keys).agg(F.count("*").alias("bins"), (F.sum("energy") / F.sum("n")).alias("_whole"))
    f = f.join(quantiles.grouped(hops, keys, {"_p": ("power", 0.9, "floor")}), keys).withColumn("floor", F.greatest(F.lit(-65.0), scalar.power_db(F.col("_p")) - 35)).drop("_p")
    top = windows.frame_mean(hops, keys, "hop", "energy", "n", {"_w": (0, wide)}).groupBy(*keys).agg(F.max("_w").alias("_best"))
    t = f.join(top, keys).withColumn("target", F.coalesce("_best", "_whole"))
    # Points 0..bins; the last repeats the cell before it. Regions between edges are numbered by their start.
    d = hops.join(t, keys)
    last = d.where(F.col("hop") == F.col("bins") - 1).withColumns({"hop": F.col("bins"), "energy": F.lit(0.0), "n": F.lit(0).cast("bigint")})
    d = d.unionByName(last)
    d = d.join(edges.select(*keys, "hop", F.lit(True).alias("_edge")), [*keys, "hop"], "left")
    d = running(materialise(d), keys, "hop", {"_reg": ("max", F.when(F.col("_edge") | (F.col("hop") == 0), F.col("hop")))})
    h = halo(d, keys, "hop", radius, radius)
    # Energy of [max(region, i - radius), min(next edge, i + radius)): the rows of the same region in reach.
    same = Window.partitionBy(*keys, "_blk", "_reg").orderBy("hop").rangeBetween(-radius, radius - 1)
    h = h.with_columns({"_ne": F.sum("energy").over(same), "_nn": F.sum("n").over(same)})
    level = scalar.power_db(F.when(F.col("_nn") > 0, F.col("_ne") / F.col("_nn")).otherwise(F.col("power")))
    correction = scalar.clamp(scalar.power_db(F.col("target")) - level, 0.0, 24.0)
    knee = scalar.smoothstep((scalar.power_db(F.col("power")) - F.col("floor")) / 6)
    d = h.with_columns({"_desired": amount * correction * knee}).own().drop("_ne", "_nn", "_edge", "_reg")
    d = windows.triangular(materialise(d), keys, "hop", "bins", "_desired", soft, "_soft")
    d = d.withColumn("_g0", scalar.gain_from_db(F.least("_desired", "_soft")))
    d = _bound(materialise(d), keys, wide)
    d = materialise(d)
    h = halo(d, keys, "hop", 1, 1)
    low = h.with_columns({"_low": F.min("_g1").over(h.reach(1, 1))}).own()
    low = windows.triangular(low, keys, "hop", "bins", "_low", soft, "_s1")
    return low.select(*keys, "hop", F.greatest(F.lit(1.0), F.least("_g1", "_s1")).alias("gain"), "target", "floor", "bins")


def _bound(points: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Apply the energy bound to the runs of windows that break it; others pass through.

    A window that holds under the initial gains holds under any smaller ones. Two
    violating windows more than their width apart share no gain, so runs of
    neighbouring violations are independent.
    """
    h = halo(points, keys, "hop", 0, width)
    nxt = F.max("_g0").over(h.window.rangeBetween(1, 1))
    h = h.with_columns({"_x": F.greatest(F.col("_g0"), F.coalesce(nxt, F.col("_g0")))})
    w = h.window.rangeBetween(0, width - 1)
    h = h.with_columns({"_out": F.sum(F.col("energy") * F.col("_x") * F.col("_x")).over(w), "_len": F.sum("n").over(w)})
    v = h.own().where((F.col("hop") + width <= F.col("bins")) & (F.col("_out") > F.col("target") * F.col("_len"))).select(*keys, "hop", "target")
    v = previous_row(materialise(v), keys, "hop", {"_p": "hop"})
    v = running(v, keys, "hop", {"_run": ("max", F.when(F.col("_p").isNull() | (F.col("hop") - F.col("_p") > width), F.col("hop")))})
    runs = v.groupBy(*keys, "_run").agg(F.max("hop").alias("_to"), F.max("target").alias("_tp"))
    runs = runs.withColumn("_end", F.col("_to") + width)
    # Points of a run: found by their block, a run spans few blocks.
    b = 4096
    r = runs.withColumn("_b", F.explode(F.sequence(F.expr(f"_run div {b}"), F.expr(f"_end div {b}"))))
    hit = points.withColumn("_b", F.expr(f"hop div {b}")).join(r, [*keys, "_b"]).where("hop BETWEEN _run AND _end").select(*keys, "_run", "_to", "_tp", "hop", "energy", "n", "_g0")
    schema = T.StructType([f for f in points.schema if f.name in (*keys, "hop")] + [T.StructField("_fix", T.DoubleType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hop")
        first, to = int(pdf["_run"].iloc[0]), int(pdf["_to"].iloc[0])
        g = kernels.bound_energy(pdf["_g0"].to_numpy(), pdf["energy"].to_numpy(), pdf["n"].to_numpy(), width, float(pdf["_tp"].iloc[0]), np.arange(0, to - first + 1))
        return pdf[[*keys, "hop"]].assign(_fix=g)

    fixed = hit.groupBy(*keys, "_run").applyInPandas(fold, schema)
    return points.join(fixed, [*keys, "hop"], "left").withColumn("_g1", F.coalesce("_fix", "_g0")).drop("_fix")


#: Segments, about, whose ramps one task plans.
RAMP_ROWS = 10_000


def ramps(segments: DataFrame, keys: list[str], rate: int, leveling: float = 1.0, speed: float = 0.5) -> DataFrame:
    """Gain pieces from segment targets; a protected segment ends a component.

    Columns start, end, seg, protected, weighted_db. One track's segments (at most
    64) are one small task; tracks are dealt over tasks by their work, since their
    few bytes would leave them to one.
    """
    segments = materialise(segments.select(*keys, "seg", "start", "end", "protected", "weighted_db"))
    parts = max(segments.sparkSession.sparkContext.defaultParallelism, math.ceil(segments.count() / RAMP_ROWS))
    schema = T.StructType([f for f in segments.schema if f.name in keys] + [
        T.StructField("start_frame", T.DoubleType()), T.StructField("end_frame", T.DoubleType()), T.StructField("start_db", T.DoubleType()),
        T.StructField("end_db", T.DoubleType()), T.StructField("shape", T.StringType()), T.StructField("capacity", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg").reset_index(drop=True)
        run = pdf["protected"].astype(int).cumsum()[~pdf["protected"]]
        rows = []
        for _, idx in run.groupby(run).groups.items():
            c = pdf.loc[idx]
            pieces, cap = kernels.ramp_component(c["start"].to_numpy(), c["end"].to_numpy(), c["weighted_db"].to_numpy(), rate, leveling, speed)
            rows += [(*p, cap) for p in pieces]
        out = pd.DataFrame(rows, columns=["start_frame", "end_frame", "start_db", "end_db", "shape", "capacity"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return segments.repartition(parts, *keys).groupBy(*keys).applyInPandas(one, schema)


def safe_scale(samples: DataFrame, keys: list[str], gain_db: str, channels: list[str], steps: int = 20) -> DataFrame:
    """Largest share of the positive gains whose output true peak stays under the ceiling.

    All shares of a fixed grid are scanned at once. The ceiling allows the input
    peak plus 0.1 dB, at most full scale; NULL when even no boost is safe.
    """
    g = F.col(gain_db)
    shares = [i / steps for i in range(steps + 1)]
    lin = [scalar.gain_from_db(F.when(g > 0, g * share).otherwise(g)) for share in shares]
    tp = peaks.true_peaks(samples, keys, "frame", channels, [*lin, F.lit(1.0)], [gain_db])
    peak = [F.col("true_peaks")[i] for i in range(steps + 2)]
    ceiling = F.least(F.lit(1.0), peak[-1] * 10 ** (0.1 / 20))
    d = tp.select(*keys, ceiling.alias("ceiling"), "true_peaks")
    safe = F.greatest(*[F.when(p <= F.col("ceiling"), share) for p, share in zip(peak, shares)])
    return d.select(*keys, "ceiling", safe.alias("share"), peak[steps].alias("planned_peak"))


def tone_correction(levels: DataFrame, keys: list[str], frame: str, slope_db: float, frame_rate: float, amount: float = 1.0, attack_s: float = 0.02, release_s: float = 0.2) -> DataFrame:
    """Band correction towards a spectral slope, ridden over time.

    `levels` has one row per frame with arrays `hz` and `db` over the bands. Boost
    only where a band is present, gentler at the extremes.
    """
    from soundgrid.operators.folds import ride_bands

    n = F.size("db")
    aim = F.transform("hz", lambda x: slope_db * F.log2(x / 1000))
    d = levels.withColumns({"_aim": aim}).withColumns({
        "_ma": F.aggregate("_aim", F.lit(0.0), lambda a, x: a + x) / n, "_mb": F.aggregate("db", F.lit(0.0), lambda a, x: a + x) / n})

    # Full strength between 55 Hz and 14 kHz, none below 28 Hz and above 18 kHz.
    def edge(hz: Column) -> Column:
        return F.least(scalar.clamp((hz - 28) / (55 - 28), 0.0, 1.0), scalar.clamp((18000 - hz) / (18000 - 14000), 0.0, 1.0))

    def one(z: Column) -> Column:
        raw = (z["_aim"] - F.col("_ma")) - (z["db"] - F.col("_mb"))
        present = scalar.clamp((z["db"] - (F.col("_mb") - 30)) / 20, 0.0, 1.0)
        return 0.30 * F.when(raw > 0, raw * present).otherwise(raw) * edge(z["hz"])

    d = d.withColumn("_raw", F.transform(F.arrays_zip("_aim", "db", "hz"), one))
    g = ride_bands(d, keys, frame, "_raw", frame_rate, attack_s, release_s, "_g")
    return g.select(*keys, frame, F.transform("_g", lambda x: scalar.clamp(amount * x, -9.0, 6.0)).alias("gain_db"))


def match_gain_db(before_lufs: Column, after_lufs: Column, after_peak: Column) -> Column:
    """Gain that restores the loudness (+-24 dB), or the -0.1 dB peak bound when it would overload."""
    g = scalar.clamp(before_lufs - after_lufs, -24.0, 24.0)
    return F.when(after_peak * scalar.gain_from_db(g) > 1, -0.1 - 20 * F.log10(after_peak)).otherwise(g)


def peak_ceiling(peak: Column, headroom_db: Column, target_db) -> Column:
    """Ceiling for a wanted reduction, never below the loudest sustained level."""
    return peak * scalar.gain_from_db(-F.least(headroom_db, F.abs(scalar.lit(target_db))))
