"""Preset validation as a rule table over typed columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundgrid.functions.rules import in_range, permutation_of, violations

# Limits and names a preset may use.
RANGES = {
    "auto_eq_amount": (0, 1), "auto_eq_attack": (0, 0.5), "auto_eq_release": (0, 2), "fade_in": (0, 60), "fade_out": (0, 60),
    "peak_reduction": (-18, 0), "beat_reduction": (-18, 0), "leveling": (0, 1), "leveler_speed": (0, 1), "punch": (0, 12),
    "soft_clip": (0, 12), "hard_clip": (0, 12), "broadband_push": (0, 9), "peak_target": (-60, 0),
}
BAND_RANGES = {
    "frequency": (20, 20000), "gain_db": (-24, 24), "q": (0.1, 10), "threshold": (-120, 24), "above_range": (0, 24), "below_range": (0, 24),
    "above_ratio": (1, 20), "below_ratio": (1, 20), "above_attack": (0.1, 200), "below_attack": (0.1, 200), "above_release": (1, 1000), "below_release": (1, 1000),
}
EQ_TARGETS = ("DEEP", "BROWN", "PINK", "WHITE", "BLUE")
NOTES = ("EIGHTH", "QUARTER", "HALF", "WHOLE")
FADES = ("LINEAR", "EXPONENTIAL", "LOGARITHMIC", "SCURVE")
SLOPES = (6, 12, 24, 36, 48)
CHAIN = ["EQ", "Dynamics", "Clip", "Limit"]
DYNAMICS = ["peak", "beat", "leveler", "punch"]
OVERSAMPLING = (1, 2, 4, 8, 16)


def preset_errors(columns: list[str]) -> Column:
    """Errors of a preset row; only the columns present are checked."""
    rules: list[tuple[str, Column]] = [(c, in_range(F.col(c), *RANGES[c])) for c in RANGES if c in columns]
    if "version" in columns:
        rules.insert(0, ("version", F.col("version") == 1))
    for c, names in (("eq_target", EQ_TARGETS), ("beat_note", NOTES), ("fade_type", FADES)):
        if c in columns:
            rules.append((c, F.col(c).isNull() | F.col(c).isin(*names)))
    if "multiband_push" in columns:
        rules.append(("multiband_push", (F.size("multiband_push") == 4) & F.forall("multiband_push", lambda x: in_range(x, 0, 6))))
    if "oversampling" in columns:
        rules.append(("oversampling", F.col("oversampling").isin(*OVERSAMPLING)))
    if "chain_order" in columns:
        with_image = F.array_contains("chain_order", "Stereo Image")
        ok = F.when(with_image, permutation_of(F.col("chain_order"), [*CHAIN, "Stereo Image"])).otherwise(permutation_of(F.col("chain_order"), CHAIN))
        rules.append(("chain_order", ok))
    if "dynamics_order" in columns:
        rules.append(("dynamics_order", permutation_of(F.col("dynamics_order"), DYNAMICS)))
    if "bands" in columns:
        rules.append(("bands", F.forall("bands", lambda b: _band_ok(b))))
    return violations(rules)


def _band_ok(b: Column) -> Column:
    ok = b["slope"].isin(*SLOPES)
    for c, (lo, hi) in BAND_RANGES.items():
        ok = ok & in_range(b[c], lo, hi)
    return F.coalesce(ok, F.lit(False))
