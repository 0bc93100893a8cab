"""Column expressions: levels, stereo descriptors, fades, frequency maps.

Every function takes and returns Spark columns, so all of it stays inside
whole-stage code generation. A missing reading is NULL, never NaN or infinity.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the measurement definitions.
POWER_FLOOR = 1e-100
LUFS_OFFSET = -0.691
ABSOLUTE_GATE_LUFS = -70.0
RELATIVE_GATE_LU = 10.0
MAX_NORMALISE_DB = 24.0
DEFAULT_CEILING_DB = -0.1


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- stereo ---------------------------------------------------------------

def mid(left: Column, right: Column) -> Column:
    return (left + right) / 2


def side(left: Column, right: Column) -> Column:
    return (left - right) / 2


def mid_power(ll: Column, rr: Column, lr: Column) -> Column:
    """Mid power from the left, right and cross powers."""
    return F.greatest(F.lit(0.0), (ll + rr + 2 * lr) / 4)


def side_power(ll: Column, rr: Column, lr: Column) -> Column:
    return F.greatest(F.lit(0.0), (ll + rr - 2 * lr) / 4)


# The names of the stereo states are part of the result.
def stereo_state(ll: Column, rr: Column, lr: Column) -> Column:
    return (
        F.when(ll + rr == 0, "silence")
        .when(ll == 0, "left_absent")
        .when(rr == 0, "right_absent")
        .when(side_power(ll, rr, lr) == 0, "dual_mono")
        .when(mid_power(ll, rr, lr) == 0, "antiphase")
        .otherwise("stereo")
    )


def correlation(ll: Column, rr: Column, lr: Column) -> Column:
    """Uncentred correlation clipped to +-1; NULL when a channel is absent."""
    d = F.sqrt(ll * rr)
    return F.when(d > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), lr / d)))


def meter_correlation(ll: Column, rr: Column, lr: Column) -> Column:
    """Meter form: sums in, 1.0 when the denominator is not above 1e-12."""
    d = F.sqrt(ll * rr)
    return F.when(d > 1e-12, lr / d).otherwise(F.lit(1.0))


def energy_share(mid_p: Column, side_p: Column) -> Column:
    """Side part of the energy, scaled so that it cannot overflow; NULL on silence."""
    s = F.greatest(mid_p, side_p)
    return F.when(s > 0, (side_p / s) / (mid_p / s + side_p / s))


def side_gain_for_share(mid_p: Column, side_p: Column, target) -> Column:
    t = lit(target)
    return F.when(
        (mid_p > 0) & (side_p > 0) & (t > 0) & (t < 1),
        F.exp(0.5 * (F.log(mid_p) - F.log(side_p) + F.log(t) - F.log1p(-t))),
    )


# --- levels ---------------------------------------------------------------

def power_db(p: Column) -> Column:
    return 10 * F.log10(F.greatest(F.lit(POWER_FLOOR), p))


def amplitude_db(a: Column) -> Column:
    """20 log10, NULL on silence."""
    return F.when(a > 0, 20 * F.log10(a))


def lufs(p: Column) -> Column:
    return F.when(p > 0, LUFS_OFFSET + 10 * F.log10(p))


def power_from_lufs(x: Column) -> Column:
    return F.pow(F.lit(10.0), (x - LUFS_OFFSET) / 10)


def gain_from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def ratio_state(num: Column, den: Column) -> Column:
    """finite | +inf | -inf | NULL (0/0), carried apart from the number."""
    return (
        F.when((den == 0) & (num == 0), F.lit(None).cast("string"))
        .when(den == 0, "+inf")
        .when(num == 0, "-inf")
        .otherwise("finite")
    )


def ratio_db(num: Column, den: Column) -> Column:
    """The finite part of a power ratio in dB; NULL in the singular states."""
    return F.when((num > 0) & (den > 0), 10 * F.log10(num / den))


# --- curves ---------------------------------------------------------------

def clamp(x: Column, lo, hi) -> Column:
    return F.least(lit(hi), F.greatest(lit(lo), x))


def smoothstep(t: Column) -> Column:
    c = clamp(t, 0.0, 1.0)
    return c * c * (3 - 2 * c)


def fade_shape(t: Column, curve: Column) -> Column:
    return (
        F.when(t <= 0, 0.0)
        .when(t >= 1, 1.0)
        .when(curve == "exponential", t * t)
        .when(curve == "logarithmic", F.sqrt(t))
        .when(curve == "scurve", t * t * (3 - 2 * t))
        .otherwise(t)
    )


def fade_factor(frame: Column, total: Column, fade_in: Column, fade_out: Column, curve: Column) -> Column:
    """Fade-in times fade-out; the last frame stays just above zero."""
    up = F.when((fade_in > 0) & (frame < fade_in), frame / fade_in).otherwise(F.lit(1.0))
    start = F.greatest(F.lit(0), total - fade_out)
    down = F.when(
        (start < total) & (frame >= start),
        F.greatest(F.lit(0.0), 1 - (frame - start) / (total - start)),
    ).otherwise(F.lit(1.0))
    return fade_shape(up, curve) * fade_shape(down, curve)


def normalise_gain(peak: Column, target_db, max_db: float = MAX_NORMALISE_DB) -> Column:
    return F.when(peak <= 0, 1.0).otherwise(
        F.least(gain_from_db(lit(target_db)) / peak, F.lit(10 ** (max_db / 20)))
    )


def safety_gain(peak: Column, target_db: float = DEFAULT_CEILING_DB) -> Column:
    """Only ever reduces: unity unless the peak exceeds full scale."""
    return F.when(peak > 1, F.lit(10 ** (target_db / 20)) / peak).otherwise(F.lit(1.0))


def ceiling_scale(peak: Column, ceiling) -> Column:
    """Scale down to a ceiling, never up."""
    return F.when(peak > 0, F.least(F.lit(1.0), lit(ceiling) / peak)).otherwise(F.lit(1.0))


def beat_release_ms(beats: Column, bpm: Column) -> Column:
    return F.when(bpm > 0, beats * 60000 / bpm).otherwise(F.lit(250.0))


def piece_gain_db(frame: Column, start: Column, end: Column, start_db: Column, end_db: Column, shape: Column) -> Column:
    u = (frame - start) / (end - start)
    return F.when(shape == "HOLD", start_db).otherwise(
        start_db + (end_db - start_db) * (3 * u * u - 2 * u * u * u)
    )


# --- frequency ------------------------------------------------------------

def display_tilt_db(hz: Column, per_octave: float = 4.5) -> Column:
    return per_octave * F.log2(hz / 1000)


def pitch_number(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def grid_index(hz: Column, low: float = 20.0, high: float = 20000.0, size: int = 512) -> Column:
    """Fractional position of a frequency on the logarithmic grid."""
    span = math.log10(high / low)
    return F.log10(F.greatest(hz, F.lit(low)) / low) / span * (size - 1)


def hann(i: Column, n, periodic: bool = True) -> Column:
    d = lit(n) if periodic else lit(n) - 1
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / d)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero, as double arithmetic sees a half.

    Spark's own rounding goes by the shortest decimals. Of values that were cut to
    three more digits before, one in a thousand ends on a half, where the two may part.
    """
    unit = F.lit(10.0**digits)
    return F.round(x * unit) / unit


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
