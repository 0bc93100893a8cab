"""Spectra as rows: (track, window, bin, powers), and everything read from them.

The discrete Fourier sums are a join of samples with their bins and one grouped
sum. They serve short windows; long PCM windows use the FFT kernel.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dft_powers(cells: DataFrame, lengths: DataFrame, keys: list[str], pos: str, length: str, n: int, hop: int, left: str, right: str) -> DataFrame:
    """One-sided LL, RR and real cross powers of periodic-Hann windows, Parseval scaled.

    Sparse input: a missing cell is zero. Only complete windows count.
    """
    i = F.col(pos) - F.col("win") * hop
    w = 0.5 - 0.5 * F.cos(2 * math.pi * i / n)
    x = (
        cells.withColumn("win", F.explode(F.sequence(
            F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(pos) + 1 - n) / hop)), F.expr(f"{pos} div {hop}"))))
        .join(lengths, keys).where(F.col("win") * hop + n <= F.col(length))
        .select(*keys, "win", i.alias("_i"), (F.col(left) * w).alias("_l"), (F.col(right) * w).alias("_r"))
    )
    a = 2 * math.pi * F.pmod(F.col("bin") * F.col("_i"), F.lit(n)) / n
    x = x.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n // 2)))).withColumns({"_c": F.cos(a), "_s": F.sin(a)})
    g = x.groupBy(*keys, "win", "bin").agg(
        *[F.sum(F.col(ch) * F.col(t)).alias(f"{ch}{t}") for ch in ("_l", "_r") for t in ("_c", "_s")])
    scale = F.when((F.col("bin") == 0) | ((F.col("bin") == n // 2) & F.lit(n % 2 == 0)), 1.0).otherwise(2.0) / (n * 0.375 * n)
    return g.select(
        *keys, "win", "bin",
        ((F.col("_l_c") ** 2 + F.col("_l_s") ** 2) * scale).alias("p_ll"),
        ((F.col("_r_c") ** 2 + F.col("_r_s") ** 2) * scale).alias("p_rr"),
        ((F.col("_l_c") * F.col("_r_c") + F.col("_l_s") * F.col("_r_s")) * scale).alias("p_lr"),
    )


def band_of(hz: Column, edges: list[float]) -> Column:
    """Index of the band whose edges hold the frequency; the top edge belongs to the last."""
    b = F.lit(0)
    for k, e in enumerate(edges[1:-1], start=1):
        b = F.when(hz >= e, k).otherwise(b)
    return b


@dataclass(frozen=True)
class Grid:
    """Logarithmic frequency grid; each point averages the bins a twelfth of an octave wide around it."""

    rate: float
    fft_size: int
    low: float
    high: float
    size: int

    def columns(self, point: str) -> dict[str, Column]:
        """hz, lo, hi and audible of a point number, as expressions."""
        hz = self.low * F.pow(F.lit(10.0), math.log10(self.high / self.low) * F.col(point) / (self.size - 1))
        top = F.lit(self.fft_size // 2).cast("bigint")
        step = self.rate / self.fft_size
        lo = F.greatest(F.lit(1).cast("bigint"), F.least(top, F.floor(hz * 2 ** (-1 / 24) / step)))
        hi = F.greatest(lo, F.least(top, F.ceil(hz * 2 ** (1 / 24) / step)))
        return {"hz": hz, "lo": lo, "hi": hi, "audible": hz <= self.rate / 2}

    def points(self) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(self.size - 1).cast("bigint"))


def project(spectrum: DataFrame, keys: list[str], grid: Grid, bin_col: str = "bin", power: str = "power", radius: int = 6) -> DataFrame:
    """Mean bin power around every grid point in dB, smoothed over +-6 points.

    The grid has a fixed number of points, so its bin table is broadcast.
    """
    table = spectrum.sparkSession.range(grid.size).withColumnRenamed("id", "point")
    p = table.withColumns(grid.columns("point")).select("point", F.explode(F.sequence("lo", "hi")).alias("_bin"))
    hits = spectrum.join(F.broadcast(p), F.col(bin_col) == F.col("_bin")).groupBy(*keys, "point").agg(F.sum(power).alias("_s"))
    tracks = spectrum.select(*keys).distinct().withColumn("point", F.explode(grid.points())).withColumns(grid.columns("point"))
    d = tracks.join(hits, [*keys, "point"], "left")
    mean = F.coalesce("_s", F.lit(0.0)) / (F.col("hi") - F.col("lo") + 1)
    d = d.withColumn("raw_db", F.when(F.col("audible"), 10 * F.log10(F.greatest(mean, F.lit(1e-12)))).otherwise(F.lit(-120.0)))
    w = Window.partitionBy(*keys).orderBy("point").rowsBetween(-radius, radius)  # fixed number of grid points
    smooth = F.when(F.col("audible"), F.avg(F.when(F.col("audible"), F.col("raw_db"))).over(w)).otherwise(F.lit(-120.0))
    return d.select(*keys, "point", "hz", "raw_db", smooth.alias("db"))


def chroma(spectrum: DataFrame, keys: list[str], hz: Column, power: str, low: float = 55.0, high: float = 5000.0) -> DataFrame:
    """Twelve pitch classes, each bin shared by its two neighbours; second smallest removed, unit length."""
    m = 69 + 12 * F.log2(hz / 440)
    part = m - F.floor(m)
    d = spectrum.where((hz >= low) & (hz <= high)).select(
        *keys, F.pmod(F.floor(m), F.lit(12)).alias("_c"), (F.col(power) * (1 - part)).alias("_a"), (F.col(power) * part).alias("_b"))

    def share(k: int) -> Column:
        return F.sum(F.when(F.col("_c") == k, F.col("_a")).when(F.col("_c") == (k - 1) % 12, F.col("_b")).otherwise(0.0))

    g = d.groupBy(*keys).agg(F.array(*[share(k) for k in range(12)]).alias("_v"))
    floor = F.array_sort("_v")[1]
    g = g.withColumn("_v", F.transform("_v", lambda x: F.greatest(F.lit(0.0), x - floor)))
    return g.select(*keys, unit("_v").alias("chroma"))


def spectral_shape(spectrum: DataFrame, keys: list[str], hz: Column, power: str, high: float, low: float = 60.0, bands: int = 8) -> DataFrame:
    """Log energies of eight log-spaced bands, centred, unit length."""
    b = F.least(F.lit(bands - 1).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor(F.log(hz / low) / (math.log(high / low) / bands))))
    d = spectrum.where((hz >= low) & (hz <= high)).select(*keys, b.alias("_b"), F.col(power).alias("_p"))
    g = d.groupBy(*keys).agg(F.array(*[F.log1p(F.sum(F.when(F.col("_b") == k, F.col("_p")).otherwise(0.0))) for k in range(bands)]).alias("_v"))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / bands
    return g.withColumn("_v", F.transform("_v", lambda x: x - mean)).select(*keys, unit("_v").alias("shape"))


def unit(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x / norm)).otherwise(F.col(v))


def pitch_salience(spectrum: DataFrame, keys: list[str], rate: float, fft_size: int, support: int, low: float, high: float, prominence: float = 16.0) -> DataFrame:
    """Thirty-six pitch bins per cell from resolved spectral peaks.

    A peak stands `prominence` times above the lower median of the bins two to four
    resolution widths away. Groups are one spectrum each.
    """
    step = rate / fft_size
    per = [*keys]
    w = Window.partitionBy(*per).orderBy("bin")
    hz = F.col("bin") * step
    inside = (hz >= low) & (hz <= high) & (F.col("bin") >= 1)
    near, far = math.ceil(2 * fft_size / support), math.floor(4 * fft_size / support)
    seen = F.when(F.col("bin") >= 1, F.col("power"))
    around = F.array_sort(F.concat(F.collect_list(seen).over(w.rangeBetween(-far, -near)), F.collect_list(seen).over(w.rangeBetween(near, far))))
    d = spectrum.withColumns({
        "_prev": F.lag("power").over(w), "_next": F.lead("power").over(w),
        "_peak": F.max(F.when(inside, F.col("power"))).over(Window.partitionBy(*per)), "_around": around})
    noise = F.try_element_at("_around", F.floor((F.size("_around") - 1) / 2).cast("int") + 1)
    floor = F.col("_peak") * 1e-12
    p = F.col("power")
    d = d.where(inside & (p > F.col("_prev")) & (p >= F.col("_next")) & (p >= F.col("_peak") * 1e-4) & (F.size("_around") > 0) & (p >= prominence * F.greatest(noise, floor)))
    a, b, c = (F.log(F.greatest(F.col(x), floor)) / 2 for x in ("_prev", "power", "_next"))
    den = a - 2 * b + c
    delta = F.when(den == 0, 0.0).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(-0.5), 0.5 * (a - c) / den)))
    d = d.withColumn("_hz", (F.col("bin") + delta) * step).where((F.col("_hz") >= low) & (F.col("_hz") <= high))
    midi = 69 + 12 * F.log2(F.col("_hz") / 440)
    d = d.withColumns({
        "_pitch": midi - 12 * F.floor(midi / 12),
        "_sal": F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + 10 * F.log10(p / F.col("_peak")) / 40))})
    d = d.withColumn("_raw", F.explode(F.sequence(F.floor(F.col("_pitch") * 3) - 3, F.floor(F.col("_pitch") * 3) + 4)))
    gap = F.abs(F.col("_pitch") - F.pmod(F.col("_raw"), F.lit(36)) / 3)
    gap = F.least(gap, 12 - gap)
    v = F.col("_sal") * (1 + F.cos(math.pi * gap)) / 2
    g = d.where(gap <= 1).groupBy(*per, F.pmod(F.col("_raw"), F.lit(36)).alias("pitch_bin")).agg(F.max(v).alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(*per))
    return g.withColumn("_t", total).where("_t > 0").select(*per, "pitch_bin", (F.col("_v") / F.col("_t")).alias("salience"))


def timbre(spectrum: DataFrame, keys: list[str], rate: float, fft_size: int, low: float = 60.0, top: float = 16000.0, bands: int = 8) -> DataFrame:
    """Relative level and contrast of eight log bands; no rows for a cell with an empty band."""
    upper = min(top, 0.95 * rate / 2)
    edges = [low * (upper / low) ** (k / bands) for k in range(bands)] + [upper]
    hz = F.col("bin") * (rate / fft_size)
    d = spectrum.where((F.col("bin") >= 1) & (hz >= low) & (hz <= upper)).withColumn("band", band_of(hz, edges))
    up = Window.partitionBy(*keys, "band").orderBy("power", "bin")
    down = Window.partitionBy(*keys, "band").orderBy(F.col("power").desc(), F.col("bin").desc())
    d = d.withColumns({
        "_up": F.row_number().over(up), "_down": F.row_number().over(down),
        "_n": F.count("*").over(Window.partitionBy(*keys, "band")), "_peak": F.max("power").over(Window.partitionBy(*keys))})
    tails = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(0.1) * F.col("_n")))
    g = d.where("_peak > 0").groupBy(*keys, "band").agg(
        F.sum("power").alias("_e"), F.max("_peak").alias("_peak"),
        F.avg(F.when(F.col("_up") <= tails, F.col("power"))).alias("_valley"),
        F.avg(F.when(F.col("_down") <= tails, F.col("power"))).alias("_top"))
    whole = Window.partitionBy(*keys)
    g = g.withColumns({"_total": F.sum("_e").over(whole), "_bands": F.count("*").over(whole)}).where(F.col("_bands") == bands)
    floor = F.col("_peak") * 1e-4
    contrast = 10 * F.log10(F.greatest("_top", floor) / F.greatest("_valley", floor))
    return g.select(
        *keys, "band", (10 * F.log10(F.greatest(F.col("_e") / F.col("_total"), F.lit(1e-4)))).alias("level_db"),
        F.least(F.lit(40.0), F.greatest(F.lit(0.0), contrast)).alias("contrast_db"))
