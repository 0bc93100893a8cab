"""Structure, similarity, references, ramps, captures, registry."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundgrid.operators import kernels, structure
from soundgrid.plans import capture, gain, leveler, references

K = ["track_id"]


def low_median(v):
    return np.sort(v, axis=0)[(len(v) - 1) // 2]


def test_novelty_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    n = 60
    v = rng.random((n, 22))
    pdf = pd.DataFrame({"track_id": 1, "idx": np.arange(n), "chroma": list(v[:, :12]), "shape": list(v[:, 12:20] - 0.5), "activity": v[:, 20], "flux": v[:, 21]})
    v[:, 12:20] -= 0.5
    got = structure.raw_novelty(spark.createDataFrame(pdf), K).toPandas()
    for r in got.itertuples():
        a, b = low_median(v[max(0, r.idx - r.radius):r.idx]), low_median(v[r.idx:r.idx + r.radius])
        cos = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
        want = 0.5 * (1 - np.clip(cos(a[:12], b[:12]), 0, 1)) + 0.3 * (1 - cos(a[12:20], b[12:20])) / 2
        want += 0.1 * abs(a[20] - b[20]) + 0.1 * abs(a[21] - b[21]) / (abs(a[21]) + abs(b[21]) + 1e-12)
        assert abs(r.raw - want) < 1e-12
    assert len(got) == 3 * (n - 1)


def test_suppression_keeps_the_best_apart(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"track_id": 1, "idx": np.sort(rng.choice(3000, 900, replace=False)), "s": np.round(rng.random(900), 2)})
    got = structure.suppress(spark.createDataFrame(pdf), K, "s", limit=65).collect()[0].boundaries
    kept = []
    for r in pdf.sort_values(["s", "idx"], ascending=[False, True]).itertuples():
        if len(kept) < 65 and all(abs(r.idx - k) >= 4 for k in kept):
            kept.append(r.idx)
    assert got == sorted(kept)


def test_merge_of_boundary_sets():
    f = leveler.merge_boundaries.func
    one = lambda a, b: f(pd.Series([a]), pd.Series([b]))[0]
    assert one([10, 30], [20]) == [10, 20, 30]
    assert one([10, 30], [12]) == [12, 30]
    assert one([10, 14], [12]) == [10, 14]
    assert one([], [5]) == [5] and one([5], []) == [5]


def bins(seed, rotate=0):
    rng = np.random.default_rng(seed)
    c, s, a = rng.random((32, 12)), rng.normal(0, 1, (32, 8)), rng.random((32, 1))
    return np.hstack([np.roll(c, rotate, axis=1), s, a]).ravel()


def test_segment_similarity():
    same = kernels.compare_bins(bins(1), bins(1), 1.0)
    assert same[-1] == "none" and np.allclose(same[:3], 1.0) and same[4] == 0
    turned = kernels.compare_bins(bins(1), bins(1, 3), 1.0)
    assert turned[4] == 3 and abs(turned[0] - 0.95) < 1e-9 and abs(turned[1] - 1) < 1e-9
    assert kernels.compare_bins(bins(1), bins(1), 1.5)[-1] == "duration_ratio"
    gap = bins(1).reshape(32, 21)
    gap[5:10] = 0
    assert kernels.compare_bins(gap.ravel(), bins(1), 1.0)[-1] == "invalid_bin_run"
    gap[5:20] = 0
    assert kernels.compare_bins(gap.ravel(), bins(1), 1.0)[-1] == "insufficient_valid_bins"
    assert kernels.compare_bins(bins(1), bins(2), 1.0)[3] < 0.9


def test_groups_and_pairs(spark):
    rows = []
    for a in range(6):
        for b in range(a + 1, 6):
            c = 0.97 if b < 3 else (0.99 if (a, b) == (3, 4) else 0.5)
            rows.append((1, a, b, c, c, c, c))
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["track_id", "a", "b", "harmonic", "timbre", "alignment", "combined"]))
    got = references.groups(d, K).toPandas()
    assert sorted(got[got.kind == "group"].seg) == [0, 1, 2] and sorted(got[got.kind == "pair"].seg) == [3, 4]
    assert (got.confidence > 0.9).all()


def test_water_filling_caps(spark):
    q = {1: [1, 0, 0], 2: [1, 1, 0], 3: [0.5] * 5}
    pdf = pd.DataFrame([(g, i, float(v)) for g, x in q.items() for i, v in enumerate(x)], columns=["g", "m", "q"])
    got = references.water_fill(spark.createDataFrame(pdf), ["g"], "m", "q").toPandas().sort_values(["g", "m"])
    w = {g: got[got.g == g].weight.to_numpy() for g in q}
    assert np.allclose(w[1], [0.4, 0.3, 0.3]) and np.allclose(w[2], [0.4, 0.4, 0.2]) and np.allclose(w[3], 0.2)


def test_ramps_fit_and_join(spark):
    pdf = pd.DataFrame({"track_id": 1, "seg": range(5), "start": [0, 9000, 20000, 31000, 40000], "end": [9000, 20000, 31000, 40000, 52000],
                        "protected": [True, False, False, True, False], "weighted_db": [0.0, 2.0, -1.0, 0.0, 0.3]})
    p = gain.ramps(spark.createDataFrame(pdf), K, 1000).toPandas().sort_values("start_frame")
    assert (p.start_frame.to_numpy()[1:] >= p.end_frame.to_numpy()[:-1] - 1e-9).all()
    assert p.start_db.iloc[0] == 0 and p.end_db.iloc[-1] == 0 and set(p["shape"]) <= {"HOLD", "SMOOTHSTEP"}
    joined = np.isclose(p.end_frame.to_numpy()[:-1], p.start_frame.to_numpy()[1:])
    assert np.allclose(p.end_db.to_numpy()[:-1][joined], p.start_db.to_numpy()[1:][joined])
    s = p[p["shape"] == "SMOOTHSTEP"]
    assert (1.5 * (s.end_db - s.start_db).abs() / ((s.end_frame - s.start_frame) / 1000) <= 2 + 1e-9).all()
    assert not ((p.start_frame < 40000) & (p.end_frame > 31000)).any()


GOOD = {
    "job": {"id": "a", "url": "u"},
    "provenance": {
        "quality": "candidate", "job": {"id": "a", "url": "u"}, "routeTailTest": False, "sourceMuted": True, "receiverMuted": True,
        "sourceMutedAfterCaptureStop": True, "pcmPersisted": False,
        "capture": {"sink": "none", "channels": 2, "rate": 48000, "settings": {"autoGainControl": False, "echoCancellation": False, "noiseSuppression": False}},
        "expectedDuration": 100.0, "capturedDuration": 100.0, "endBoundary": {"time": 99.9}, "inputGaps": [{"startFrame": 0, "frames": 480}],
        "timeline": [{"ad": False, "rate": 1.0, "volume": 0.5, "duration": 100.0, "elapsed": 20.0, "capturedFrames": 960000}]},
    "measurement": {"sample_rate": 48000, "frames": 4800000, "duration_s": 100.0, "sample_peak_lr": [0.5, 0.4], "full_file": {"mid_power": 0.1, "side_power": 0.0}, "long_windows": 66},
    "settings": {"stableVolume": "off", "menuAfter": [{"checked": "false", "text": "Stable volume"}]},
    "events": [],
}
BROKEN = {
    "capture_not_candidate": ("provenance.quality", "partial"), "source_url_mismatch": ("provenance.job.url", "x"), "source_id_mismatch": ("provenance.job.id", "x"),
    "tail_diagnostic_not_corpus": ("provenance.routeTailTest", True), "mute_invariant:receiverMuted": ("provenance.receiverMuted", None),
    "unexpected_persisted_audio": ("provenance.pcmPersisted", True), "not_silent_sink": ("provenance.capture.sink", "default"), "invalid_capture_format": ("provenance.capture.channels", 1),
    "capture_enhancement:noiseSuppression": ("provenance.capture.settings.noiseSuppression", True), "end_boundary_unverified": ("provenance.endBoundary.time", 99.6),
    "missing_interior_audio_input": ("provenance.inputGaps", [{"startFrame": 480000, "frames": 48000}]), "advertising_contamination": ("provenance.timeline.0.ad", True),
    "playback_rate_changed": ("provenance.timeline.0.rate", 1.25), "content_duration_changed": ("provenance.timeline.0.duration", 90.0),
    "sample_clock_drift": ("provenance.timeline.0.capturedFrames", 1060000), "dynamic_platform_gain_unverified": ("settings.stableVolume", "on"),
    "stable_volume_enabled": ("settings.menuAfter.0.checked", "true"), "measurement_sample_rate": ("measurement.sample_rate", 44100),
    "no_measurable_content": ("measurement.sample_peak_lr", [0.0, 0.0]), "invalid_ms_power": ("measurement.full_file.side_power", -1.0), "missing_spectral_timeline": ("measurement.long_windows", 0),
    "no_clock_evidence": ("provenance.timeline.0.elapsed", 5.0),
}


def test_each_capture_rule(spark, tmp_path):
    rows = [("good", GOOD)]
    for reason, (path, value) in BROKEN.items():
        row = json.loads(json.dumps(GOOD))
        at = row
        *head, last = path.split(".")
        for p in head:
            at = at[int(p)] if p.isdigit() else at[p]
        at[int(last) if last.isdigit() else last] = value
        rows.append((reason, row))
    f = tmp_path / "captures.json"
    f.write_text("\n".join(json.dumps({"name": n, **r}) for n, r in rows))
    d = spark.read.schema("name string, " + capture.SCHEMA).json(str(f))
    got = {r.name: r for r in capture.audit(d).select("name", "errors", "accepted", "clock_evidence").collect()}
    assert got["good"].accepted and got["good"].clock_evidence == "per_second"
    for reason in BROKEN:
        assert got[reason].errors == [reason], (reason, got[reason].errors)


def test_registry_covers_names_and_columns(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 90
    assert entry.entry(spark).columns == ["track_id", "n_blocks", "n_absolute", "n_selected", "lufs"]


@pytest.mark.parametrize("files", [1, 4, 80])
def test_streams_equal_batch_over_many_files(spark, tmp_path, files):
    """The registered queries, with their own settings, over a table folder of shuffled files."""
    from soundgrid.operators import loudness, peaks
    from soundgrid.queries import live
    from soundgrid.sources.views import HOP, event_samples
    from soundgrid.streaming import streams

    root = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{root}/events.parquet")
    e.repartition(files, F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    read = streams.read_table

    def one_by_one(spark, root, name):
        return read(spark, root, name, per_trigger=max(1, files // 8))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(streams, "read_table", one_by_one)
        loud = live.stream_loudness(spark, str(tmp_path)).toPandas().sort_values(["track_id", "win"])
        peak = live.stream_true_peak(spark, str(tmp_path)).toPandas().sort_values("track_id")
        energy = live.stream_windows(spark, str(tmp_path)).count()
    t = loudness.timeline(event_samples(spark, root), K, HOP).where("m_power > 0").toPandas().sort_values(["track_id", "hop"])
    assert list(loud.win) == list(t.hop) and np.allclose(loud.lufs, -0.691 + 10 * np.log10(t.m_power), atol=1e-5)
    want = peaks.true_peak(event_samples(spark, root), K, "frame", ["l", "r"]).toPandas().sort_values("track_id")
    assert np.allclose(peak.true_peak, want.true_peak, atol=1e-8)
    assert energy == live.stream_windows(spark, root).count()


def test_late_rows_are_not_lost_in_silence(spark, tmp_path):
    from soundgrid.streaming import streams

    for i, frames in enumerate(((0, 90_000), (90_001,), (5, 7))):
        spark.createDataFrame([(1, f, 1.0) for f in frames], "track_id long, frame long, l double").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in[012]"))
    sums = {"energy": F.sum("l")}
    with pytest.raises(ValueError, match="later than the watermark"):
        streams.drain(streams.sliding_sums(stream, ["track_id"], 3600, 360, 360, sums, late="1 second"), ["track_id", "win"])
    whole = streams.drain(streams.sliding_sums(stream, ["track_id"], 3600, 360, 360, sums), ["track_id", "win"])
    assert whole.agg(F.sum("energy")).first()[0] == 5


def test_novelty_over_many_blocks_and_batches(spark):
    """Blocks of several tracks share a batch, and a block may go on in the next one."""
    rng = np.random.default_rng(3)
    sizes = {1: 1, 2: 2, 3: 40, 4: 5000, 5: 17, 6: 33}
    pdf = pd.concat([pd.DataFrame({"track_id": k, "idx": np.arange(n)}) for k, n in sizes.items()], ignore_index=True)
    v = np.round(rng.random((len(pdf), 22)), 2)
    pdf = pdf.assign(chroma=list(v[:, :12]), shape=list(v[:, 12:20]), activity=v[:, 20], flux=v[:, 21])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        plan = structure.raw_novelty(spark.createDataFrame(pdf), K)
        got = plan.toPandas().set_index(["track_id", "idx", "radius"]).raw
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * sum(n - 1 for n in sizes.values())
    at = {k: v[(pdf.track_id == k).to_numpy()] for k in sizes}
    for k, i, r in [(2, 1, 16), (3, 20, 8), (3, 39, 16), (4, 4095, 16), (4, 4096, 16), (4, 4097, 4), (4, 4999, 8), (5, 8, 16), (6, 32, 4)]:
        a, b = low_median(at[k][max(0, i - r):i]), low_median(at[k][i:i + r])
        cos = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
        want = 0.5 * (1 - np.clip(cos(a[:12], b[:12]), 0, 1)) + 0.3 * (1 - cos(a[12:20], b[12:20])) / 2
        want += 0.1 * abs(a[20] - b[20]) + 0.1 * abs(a[21] - b[21]) / (abs(a[21]) + abs(b[21]) + 1e-12)
        assert abs(got[k, i, r] - want) < 1e-12


def test_best_attempt_audits_each_capture_once(spark):
    rows = [(1, 5, True, "30s_progress"), (1, 7, True, "per_second"), (1, 9, True, "per_second"), (1, 3, False, "per_second"), (2, 4, False, "missing"), (3, 8, True, "missing")]
    d = capture.best_attempts(spark.createDataFrame(rows, "job long, at long, accepted boolean, clock_evidence string"), "job", "at")
    assert {tuple(r) for r in d.collect()} == {(1, 4, 3, 7), (2, 1, 0, None), (3, 1, 1, 8)}


def test_best_attempt_reads_captures_once(spark):
    from soundgrid.queries import load

    plan = load()["best_attempt"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == plan.count("Relation [o_orderkey") == 1


def test_ticks_of_the_live_spectrum_together_equal_one_by_one():
    from soundgrid.streaming import streams

    rng, fft = np.random.default_rng(3), 64
    f = np.sort(rng.integers(0, 900, 200))
    x, win = rng.normal(size=(2, 200)), kernels.hann(fft)
    lo = np.arange(1, 21)
    hi = lo + 3
    ends = 63 + 32 * np.arange(26)
    got = streams.tick_levels(f, x, ends, win, lo, hi)
    for k, end in enumerate(ends):
        buf, inside = np.zeros((2, fft)), (f > end - fft) & (f <= end)
        for c in range(2):
            np.add.at(buf[c], f[inside] - (end - fft + 1), x[c, inside])
        p = (np.abs(np.fft.rfft(buf * win)) ** 2).mean(0)
        raw = np.array([10 * np.log10(max(p[a:b + 1].mean(), 1e-12)) for a, b in zip(lo, hi)])
        assert np.allclose(got[k], [raw[max(0, i - 6):i + 7].mean() for i in range(20)], atol=1e-9)
