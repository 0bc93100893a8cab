"""Accept or reject one capture of a recording by independent rules.

The nested records are read with an explicit schema; every rule is a column
expression, with higher-order predicates over the timeline and the gaps.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundgrid.functions.rules import violations

RATE = 48000

SCHEMA = """
job struct<id: string, url: string>,
provenance struct<
  quality: string, job: struct<id: string, url: string>, routeTailTest: boolean,
  sourceMuted: boolean, receiverMuted: boolean, sourceMutedAfterCaptureStop: boolean, pcmPersisted: boolean,
  capture: struct<sink: string, channels: int, rate: int,
                  settings: struct<autoGainControl: boolean, echoCancellation: boolean, noiseSuppression: boolean>>,
  expectedDuration: double, capturedDuration: double, endBoundary: struct<time: double>, tailGuardSeconds: double,
  inputGaps: array<struct<startFrame: bigint, frames: bigint>>,
  timeline: array<struct<ad: boolean, rate: double, volume: double, duration: double, elapsed: double, capturedFrames: bigint>>>,
measurement struct<sample_rate: int, frames: bigint, duration_s: double, sample_peak_lr: array<double>,
  full_file: struct<mid_power: double, side_power: double>, long_windows: int>,
settings struct<stableVolume: string, menuAfter: array<struct<checked: string, text: string>>>,
events array<struct<kind: string, seconds: double, frames: bigint>>
"""


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def derived(captures: DataFrame) -> DataFrame:
    """The arrays that several rules read, each computed once."""
    timeline, events = F.coalesce("provenance.timeline", F.array()), F.coalesce("events", F.array())
    late = F.filter(events, lambda r: (r["kind"] == "PROGRESS") & (F.coalesce(r["seconds"], F.lit(0.0)) > 10))
    return captures.withColumns({
        "_timeline": timeline,
        "_clocks": F.filter(timeline, lambda r: r["capturedFrames"].isNotNull() & (r["elapsed"] > 10)),
        "_progress": late,
        "_volumes": F.transform(timeline, lambda r: r["volume"]),
        "_menu": F.coalesce("settings.menuAfter", F.array()),
        "_gaps": F.coalesce("provenance.inputGaps", F.array())})


def capture_rules() -> list[tuple[str, Column]]:
    """Rules over a derived() table, in the order in which their names are reported."""
    p, m = F.col("provenance"), F.col("measurement")
    duration, elapsed = _zero(p["expectedDuration"]), _zero(m["duration_s"])
    boundary, guard = _zero(p["endBoundary"]["time"]), F.coalesce(p["tailGuardSeconds"], F.lit(0.25))
    timeline, volumes, clocks, progress, menu = (F.col(c) for c in ("_timeline", "_volumes", "_clocks", "_progress", "_menu"))
    fine = (F.size(timeline) > 0) & F.forall(volumes, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))
    interior = F.exists(
        F.col("_gaps"),
        lambda g: (g["startFrame"] / RATE > 0.5) & ((g["startFrame"] + g["frames"]) / RATE < duration - 5))

    def power_ok(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))

    # The rules' names and limits are part of the result.
    return [
        ("capture_not_candidate", p["quality"] == "candidate"),
        ("source_url_mismatch", p["job"]["url"] == F.col("job.url")),
        ("source_id_mismatch", p["job"]["id"] == F.col("job.id")),
        ("tail_diagnostic_not_corpus", ~F.coalesce(p["routeTailTest"], F.lit(False))),
        *[(f"mute_invariant:{k}", p[k]) for k in ("sourceMuted", "receiverMuted", "sourceMutedAfterCaptureStop")],
        ("unexpected_persisted_audio", ~p["pcmPersisted"]),
        ("not_silent_sink", p["capture"]["sink"] == "none"),
        ("invalid_capture_format", (p["capture"]["channels"] == 2) & (p["capture"]["rate"] == RATE)),
        *[(f"capture_enhancement:{k}", ~p["capture"]["settings"][k]) for k in ("autoGainControl", "echoCancellation", "noiseSuppression")],
        ("invalid_content_duration", duration >= 90),
        ("sample_clock_duration_mismatch", (elapsed >= duration - 0.5) & (elapsed <= duration + 3)),
        ("frame_duration_mismatch", F.abs(elapsed - _zero(m["frames"]) / RATE) < 1e-9),
        ("provenance_duration_mismatch", F.abs(elapsed - _zero(p["capturedDuration"])) < 1e-9),
        ("end_boundary_unverified", (boundary >= duration - guard - 0.03) & (boundary <= duration + 0.01)),
        ("insufficient_content_coverage", (duration > 0) & (boundary / F.greatest(duration, F.lit(1.0)) >= 0.995)),
        ("missing_interior_audio_input", ~interior),
        ("missing_timeline", F.size(timeline) > 0),
        ("advertising_contamination", F.forall(timeline, lambda r: ~F.coalesce(r["ad"], F.lit(True)))),
        ("playback_rate_changed", F.forall(timeline, lambda r: F.coalesce(r["rate"] == 1, F.lit(False)))),
        ("missing_player_gain", fine),
        ("player_gain_changed", ~fine | (F.array_max(volumes) - F.array_min(volumes) < 1e-7)),
        ("content_duration_changed", F.forall(timeline, lambda r: F.abs(_zero(r["duration"]) - duration) < 0.05)),
        ("sample_clock_drift", F.forall(clocks, lambda r: F.abs(r["capturedFrames"] / RATE - r["elapsed"]) <= 0.75)),
        ("progress_sample_clock_drift", F.forall(progress, lambda r: F.abs(r["frames"] / RATE - r["seconds"]) <= 0.75)),
        ("no_clock_evidence", (F.size(clocks) > 0) | (F.size(progress) > 0)),
        ("dynamic_platform_gain_unverified", F.col("settings.stableVolume").isin("off", "not_offered_in_content_menu", "unavailable")),
        ("stable_volume_enabled", ~F.exists(menu, lambda r: (r["checked"] == "true") & (
            F.lower(r["text"]).contains("stable volume") | F.lower(r["text"]).contains("volumen estable")))),
        ("measurement_sample_rate", m["sample_rate"] == RATE),
        ("no_measurable_content", F.array_max(m["sample_peak_lr"]) > 1e-4),
        ("invalid_ms_power", power_ok(m["full_file"]["mid_power"]) & power_ok(m["full_file"]["side_power"])),
        ("missing_spectral_timeline", F.coalesce(m["long_windows"], F.lit(0)) > 0),
    ]


def audit(captures: DataFrame) -> DataFrame:
    """Adds errors, accepted, and the kind of clock evidence."""
    evidence = F.when(F.size("_clocks") > 0, "per_second").when(F.size("_progress") > 0, "30s_progress").otherwise("missing")
    audited = derived(captures).withColumn("errors", violations(capture_rules()))
    return audited.withColumn("accepted", F.size("errors") == 0).withColumn("clock_evidence", evidence).select(*captures.columns, "errors", "accepted", "clock_evidence")


def best_attempts(audited: DataFrame, job: str, order: str) -> DataFrame:
    """Attempts of each job, those accepted, and the best: a continuous clock first, then the earliest; null if none is accepted.

    One aggregation, so that every capture is audited once and a job with very many
    attempts is combined on the map side.
    """
    rank = F.struct((F.col("clock_evidence") != "per_second").cast("int"), F.col(order))
    return audited.groupBy(job).agg(
        F.count("*").alias("attempts"), F.sum(F.col("accepted").cast("bigint")).alias("accepted_attempts"), F.min_by(order, F.when(F.col("accepted"), rank)).alias("best"))
