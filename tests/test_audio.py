"""Sample-level work on generated signals with known answers."""
import re
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundgrid.operators import folds, kernels, loudness, onsets, pcm, peaks
from soundgrid.plans import gain, jobs
from soundgrid.sources import sinks, wav

K = ["track_id"]


def frames(spark, tracks):
    parts = [pd.DataFrame({"track_id": k, "frame": np.arange(len(x)), "l": x[:, 0], "r": x[:, 1]}) for k, x in tracks.items()]
    return spark.createDataFrame(pd.concat(parts))


def weigh_loop(x, rate):
    s, h = kernels.weighting(rate)
    z, out = [0.0] * 4, []
    for v in x:
        u = s[0] * v + z[0]
        z[0], z[1] = s[1] * v - s[3] * u + z[1], s[2] * v - s[4] * u
        w = h[0] * u + z[2]
        z[2], z[3] = h[1] * u - h[3] * w + z[3], h[2] * u - h[4] * w
        out.append(w)
    return np.array(out)


def test_weighting_across_chunks(spark):
    rate, width = 8000, 800
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (5000, 2))
    x[1500:2600] = 0
    e = pcm.weighted_energy(pcm.chunks(frames(spark, {1: x}), K, width), K, width, rate).toPandas().sort_values("chunk")
    y = np.stack([weigh_loop(x[:, c], rate) for c in range(2)], axis=1)
    want = [(y[i:i + width] ** 2).sum() for i in range(0, 5000, width)]
    assert np.allclose(e.energy, want, rtol=1e-11) and e.n.sum() == 5000


@pytest.mark.parametrize("rate", [3600, 8000, 44100, 96000])
def test_weighting_is_one_analogue_filter_at_all_rates(rate):
    def gain(r, hz):
        z = np.exp(-2j * np.pi * hz / r) ** np.arange(3)
        return np.prod([abs(f[:3] @ z) / abs(np.array([1, *f[3:]]) @ z) for f in kernels.weighting(r)])

    for hz in (5, 38, 200, 1000, 1600):  # the same point of the analogue filter: tan(pi hz / rate) grows with the rate
        same = np.arctan(np.tan(np.pi * hz / rate) * rate / 48000) * 48000 / np.pi
        assert np.isclose(gain(rate, hz), gain(48000, same), rtol=1e-6)


def test_weighting_of_sparse_tracks(spark):
    rate, width, rng = 3600, 360, np.random.default_rng(2)
    tracks = {k: np.zeros((n, 2)) for k, n in ((1, 5000), (2, 361), (3, 20_000), (4, 100))}
    for x in tracks.values():
        at = rng.choice(len(x), max(2, len(x) // 500), replace=False)
        x[at] = rng.normal(0, 1, (len(at), 2))
        x[-1] = 1.0
    rows = pd.concat([pd.DataFrame({"track_id": k, "frame": np.flatnonzero(x.any(1)), "l": x[x.any(1), 0], "r": x[x.any(1), 1]}) for k, x in tracks.items()])
    weighted = pcm.weighted_energy(pcm.chunks(spark.createDataFrame(rows), K, width), K, width, rate)
    plan = weighted._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan  # one pass, no lists of chunks
    e = weighted.toPandas().sort_values(["track_id", "chunk"])
    for k, x in tracks.items():
        y = np.stack([weigh_loop(x[:, c], rate) for c in range(2)], axis=1)
        want = [(y[i:i + width] ** 2).sum() for i in range(0, len(x), width)]
        got = e[e.track_id == k]
        assert list(got.chunk) == list(range(len(want))) and got.n.sum() == len(x)
        assert np.allclose(got.energy, want, rtol=1e-9, atol=1e-12)


def test_report_reads_its_timeline_once_written(spark):
    from soundgrid.plans import jobs

    x = np.random.default_rng(3).normal(0, 0.1, (20_000, 2))
    for rate in (None, 3600):
        plan = jobs.output_report(frames(spark, {1: x}), K, 360, rate)._jdf.queryExecution().optimizedPlan().toString()
        assert "_me#" not in plan and "_se#" not in plan  # gates, maxima and range don't repeat the windows


def test_full_scale_sine_reads_minus_three(spark):
    rate = 48000
    t = np.arange(4 * rate) / rate
    x = np.stack([np.sin(2 * np.pi * 997 * t), np.zeros(len(t))], axis=1)
    energy = (kernels.weigh(x.T.copy(), rate)[0] ** 2).sum(0).reshape(-1, 4800).sum(1)
    d = spark.createDataFrame(pd.DataFrame({"track_id": 1, "hop": np.arange(len(energy)), "n": 4800, "energy": energy}))
    got = loudness.integrated(loudness.from_hops(d, K, 4800), K).collect()[0]
    assert abs(got.lufs + 3.01) < 0.02 and got.n_blocks == 37


def test_true_peak_between_samples(spark):
    t = np.arange(400)
    tone = np.sin(np.pi / 2 * t + np.pi / 4)
    x = np.stack([tone, 0.25 * np.roll(tone, 1)], axis=1)
    d = frames(spark, {1: x, 2: x * 0.1})
    got = {r.track_id: r for r in peaks.true_peak(d, K, "frame", ["l", "r"]).collect()}
    brute = max(np.abs(np.convolve(np.concatenate([x[:, c], np.zeros(6)]), p)[:406]).max() for c in range(2) for p in peaks.TRUE_PEAK_PHASES)
    assert abs(got[1].true_peak - brute) < 1e-12
    assert 2.5 < 20 * np.log10(got[1].true_peak / got[1].sample_peak) < 3.6
    assert abs(got[2].true_peak - 0.1 * brute) < 1e-12


def test_long_term_spectrum_and_bands(spark):
    rate, hop = 8000, 256
    t = np.arange(9000) / rate
    x = np.stack([np.sin(2 * np.pi * 1000 * t), 0.5 * np.sin(2 * np.pi * 250 * t)], axis=1)
    fr = pcm.stft_frames(pcm.chunks(frames(spark, {1: x, 2: 0.5 * x}), K, hop), K, 4)
    s = pcm.long_term_spectrum(fr, K, hop, 4).toPandas().sort_values("bin")
    w = kernels.hann(1024)
    pad = np.vstack([np.zeros((768, 2)), x, np.zeros((1024, 2))])
    there = np.concatenate([np.zeros(768), np.ones(len(x)), np.zeros(1024)])
    power, weight = 0, 0
    for start in range(0, 768 + len(x), hop):
        power = power + (np.abs(np.fft.rfft(pad[start:start + 1024].T * w)) ** 2).sum(0)
        weight += (there[start:start + 1024] * w * w).sum() / (w * w).sum()
    assert np.allclose(s[s.track_id == 1].power, power / weight / 2, rtol=1e-9, atol=1e-12)
    assert np.allclose(s[s.track_id == 2].power * 4, s[s.track_id == 1].power)
    b = pcm.band_levels(fr, K, hop, 4, rate).where("track_id = 1 AND frame = 10").collect()[0]
    assert abs(b.hz[int(np.argmax(b.db))] - 1000) < 40


def test_followers_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    v = 1 - rng.random(900) * (rng.random(900) < 0.1)
    d = spark.createDataFrame(pd.DataFrame({"track_id": 1, "hop": np.arange(900), "g": v}))
    got = folds.smooth_gain(d, K, "hop", "g", 10.0, 0.05, 0.5, "y", block=100).toPandas().sort_values("hop")
    want = kernels.follow_down(v, folds.coefficient(0.05, 10.0), folds.coefficient(0.5, 10.0))
    assert np.abs(got.y.to_numpy() - want).max() < 1e-14
    p = np.abs(rng.normal(0, 0.6, 900))
    d = spark.createDataFrame(pd.DataFrame({"track_id": 1, "hop": np.arange(900), "p": p}))
    got = folds.limiter(d, K, "hop", "p", 0.5, 6, 4, "y", block=64).toPandas().sort_values("hop")
    assert np.abs(got.y.to_numpy() - kernels.limiter_envelope(p, 0.5, 6, 4)).max() < 1e-12
    assert (p * got.y <= 0.5 + 1e-12).all() and got.y.max() <= 1


def test_headroom_of_sparse_samples(spark):
    a = np.zeros(3000)
    a[::37] = 0.2
    a[1500:1700] = 0.5
    a[2500] = 1.0
    rate, atk, rel = 1000, 0.06, 0.3
    ca, cr = folds.coefficient(atk, rate), folds.coefficient(rel, rate)
    env, best = 0.0, 0.0
    for v in a:
        env = v + (ca if v > env else cr) * (env - v)
        best = max(best, env)
    s = spark.createDataFrame(pd.DataFrame({"track_id": 1, "frame": np.flatnonzero(a), "a": a[a > 0]}))
    got = folds.headroom(s, K, "frame", "a", rate, atk, rel).collect()[0]
    assert abs(got.sustain - best) < 1e-12 and got.peak == 1.0


def macro_loop(energy, n, edges, rate, hop, speed):
    """Plain loop over one track."""
    bins, power = len(energy), energy / n
    db = lambda p: 10 * np.log10(max(1e-100, p))
    floor = max(-65, db(np.sort(power)[int((bins - 1) * 0.9)]) - 35)
    wide = max(1, round(3 * rate / hop))
    target = max(energy[i:i + wide].sum() / n[i:i + wide].sum() for i in range(bins - wide + 1))
    radius = max(1, int(6 * (1 / 3) ** speed * 0.5 * rate / hop + 0.5))
    soft = max(1, int(0.6 * (1 / 6) ** speed * rate / hop + 0.5))
    cuts = [0, *edges, bins]
    want = []
    for i in range(bins + 1):
        lo = max(c for c in cuts[:-1] if c <= i)
        hi = min([c for c in cuts if c > i] or [bins])
        a, b = max(lo, i - radius), min(hi, i + radius)
        level = db(energy[a:b].sum() / n[a:b].sum()) if b > a else db(power[min(i, bins - 1)])
        knee = min(1, max(0, (db(power[min(i, bins - 1)]) - floor) / 6))
        want.append(min(24, max(0, db(target) - level)) * knee * knee * (3 - 2 * knee))
    tri = lambda v: np.array([sum((soft + 1 - abs(j)) * v[min(bins, max(0, i + j))] for j in range(-soft, soft + 1)) / (soft + 1) ** 2 for i in range(bins + 1)])
    g = 10 ** (np.minimum(want, tri(want)) / 20)
    g = kernels.bound_energy(g, energy, n, wide, target, np.arange(bins - wide + 1))
    low = np.array([g[max(0, i - 1):i + 2].min() for i in range(bins + 1)])
    return np.maximum(1, np.minimum(g, tri(low))), target, wide


def test_macro_curve_matches_a_loop_and_keeps_its_bound(spark):
    rate, hop = 1000, 100
    rng = np.random.default_rng(3)
    level = np.repeat([0.02, 0.5, 0.05, 0.3, 0.1], 60) * rng.uniform(0.7, 1.3, 300)
    n = np.full(300, hop)
    n[-1] = 40
    energy = level**2 * n
    h = spark.createDataFrame(pd.DataFrame({"track_id": 1, "hop": np.arange(300), "energy": energy, "n": n, "peak": level}))
    e = spark.createDataFrame(pd.DataFrame({"track_id": 1, "hop": [60, 120, 180]}))
    got = gain.macro_curve(h, e, K, rate, hop).toPandas().sort_values("hop")
    want, target, wide = macro_loop(energy, n, [60, 120, 180], rate, hop, 0.5)
    assert len(got) == 301 and np.allclose(got.gain, want, rtol=1e-9)
    assert got.gain.min() >= 1 and got.gain.max() > 2
    x = np.maximum(got.gain.to_numpy()[:-1], got.gain.to_numpy()[1:])
    out = [(energy[i:i + wide] * x[i:i + wide] ** 2).sum() / n[i:i + wide].sum() for i in range(300 - wide + 1)]
    assert max(out) <= target * (1 + 1e-9)


def wav_bytes(x, rate, bits, tag=1):
    if tag == 3:
        body = x.astype("<f4").tobytes()
    elif bits == 24:
        v = np.round(x * 8388607).astype("<i4")
        body = v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    ch = x.shape[1]
    fmt = struct.pack("<HHIIHH", tag, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_wav_ingest_and_results(spark, tmp_path):
    rate = 8000
    t = np.arange(2050) / rate
    x = np.stack([0.5 * np.sin(2 * np.pi * 440 * t), 0.25 * np.cos(2 * np.pi * 440 * t)], axis=1)
    for name, bits, tag in (("a.wav", 16, 1), ("b.dat", 24, 1), ("c.wav", 32, 1), ("d.wav", 32, 3)):
        (tmp_path / name).write_bytes(wav_bytes(x, rate, bits, tag))
    (tmp_path / "mono.wav").write_bytes(wav_bytes(x[:, :1], rate, 16))
    (tmp_path / "bad.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEjunk")
    (tmp_path / "song.mp3").write_bytes(b"ID3\x03rest")
    (tmp_path / "cut.wav").write_bytes(wav_bytes(x, rate, 16)[:-10])
    d = wav.ingest(spark, str(tmp_path)).cache()
    tr = {r.path.split("/")[-1]: r for r in wav.tracks(d).collect()}
    assert set(tr) == {"a.wav", "b.dat", "c.wav", "d.wav", "mono.wav"} and all(r.frames == 2050 and r.rate == rate for r in tr.values())
    assert {r.path.split("/")[-1]: r.reason for r in wav.failures(d).collect()} == {"bad.wav": "missing_chunk", "cut.wav": "truncated", "song.mp3": "mp3_not_decoded"}
    s = wav.samples(d).toPandas()
    for name in tr:
        got = s[s.path.str.endswith(name)].sort_values("frame")
        assert np.abs(got.l.to_numpy() - x[:, 0]).max() < 1e-4
        assert np.abs(got.r.to_numpy() - x[:, 0 if name == "mono.wav" else 1]).max() < 1e-4
    assert d.where("failure IS NULL").groupBy("path").agg(F.max("chunk")).collect()[0][1] == 2
    out = d.withColumn("kind", F.lit("wav")).select("path", "chunk", "failure", "kind")
    for _ in range(2):
        sinks.write_results(out, str(tmp_path / "out"), ["kind"])
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 15
    assert spark.read.parquet(str(tmp_path / "out/failures")).count() == 3


def clicks(bpm, beats, weak=None):
    p = 60 / bpm
    t = [round(i * p, 2) for i in range(beats)]
    s = [1.0] * beats
    if weak:
        t += [round(i * p + p / 2, 2) for i in range(beats)]
        s += [weak] * beats
    return pd.DataFrame({"t": t, "strength": s})


def test_tempo(spark):
    on = pd.concat([
        clicks(120, 60).assign(track_id=1), clicks(96, 60, 0.3).assign(track_id=2), clicks(120, 5).assign(track_id=3),
        pd.concat([clicks(100, 40), clicks(140, 56).assign(t=lambda d: d.t + 24.3)]).assign(track_id=4)])
    got = {r.track_id: r for r in onsets.tempo(spark.createDataFrame(on), K).collect()}
    assert abs(got[1].bpm - 120) <= 0.5 and got[1].confidence >= 0.25
    assert abs(got[2].bpm - 96) <= 0.75
    assert got[3].bpm == 0 and got[3].confidence == 0
    assert got[4].verdict in ("conflict", "weak_half", "whole")


def test_stage_chain_checks_order_and_needs(spark):
    d = spark.range(3)
    a = jobs.Stage("a", lambda x: x.withColumn("x", F.lit(1)), ("id",), ("x",))
    b = jobs.Stage("b", lambda x: x.withColumn("y", F.col("x") + 1), ("x",), ("y",))
    assert d.transform(jobs.chain([a, b])).columns == ["id", "x", "y"]
    with pytest.raises(ValueError):
        d.transform(jobs.chain([a, b], ["b", "a"]))
    with pytest.raises(ValueError):
        jobs.chain([a, b], ["a", "a"])


def test_report_ignores_gain_and_swap(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, (8000, 2)) * np.array([1, 0.5])
    d = frames(spark, {1: x, 2: x[:, ::-1], 3: x * 0.5})
    r = {v.track_id: v for v in jobs.output_report(d, K, 100, 1000).collect()}
    assert abs(r[1].integrated - r[2].integrated) < 1e-9 and abs(r[1].integrated - r[3].integrated - 20 * np.log10(2)) < 1e-9
    assert abs(r[1].correlation - r[3].correlation) < 1e-12 and abs(r[1].lra - r[3].lra) < 1e-9


def test_tone_correction_matches_a_loop(spark):
    rng = np.random.default_rng(6)
    hz = 20 * 2 ** (np.arange(90) / 12)
    db = rng.uniform(-70, 0, (40, 90))
    d = spark.createDataFrame(pd.DataFrame({"track_id": 1, "frame": np.arange(40), "db": list(db), "hz": [hz] * 40}))
    got = gain.tone_correction(d, K, "frame", -3.0, 10.0).toPandas().sort_values("frame")
    aim = -3 * np.log2(hz / 1000)
    edge = np.minimum(np.clip((hz - 28) / 27, 0, 1), np.clip((18000 - hz) / 4000, 0, 1))
    a, r, g, want = np.exp(-1 / 0.2), np.exp(-1 / 2.0), None, []
    for row in db:
        raw = (aim - aim.mean()) - (row - row.mean())
        raw = np.where(raw > 0, raw * np.clip((row - row.mean() + 30) / 20, 0, 1), raw) * 0.3 * edge
        g = raw if g is None else np.array([x + (a if abs(x) > abs(y) else r) * (y - x) for x, y in zip(raw, g)])
        want.append(np.clip(g, -9, 6))
    assert np.allclose(np.stack(got.gain_db), want, atol=1e-12)


def test_side_plan_does_not_depend_on_blocks(spark, monkeypatch):
    from soundgrid.operators import blocks

    rng = np.random.default_rng(7)
    n = 1500
    level = np.repeat(rng.uniform(0.05, 1, 15), 100)
    pdf = pd.DataFrame({"track_id": 1, "cell": np.arange(n), "m": level * rng.uniform(0.5, 1, n), "s": rng.uniform(0.01, 0.4, n) * level})
    d = spark.createDataFrame(pdf)
    one = gain.side_plan(d, K, 0.1).toPandas().sort_values("cell")
    plain = gain.halo
    monkeypatch.setattr(gain, "halo", lambda df, keys, pos, b, a: blocks.Halo(*_blocked(df, keys, pos, b, a, 97)))
    many = gain.side_plan(d, K, 0.1).toPandas().sort_values("cell")
    assert plain is not gain.halo and len(many) == n
    assert np.allclose(one.level, many.level) and np.allclose(one.guard, many.guard)
    assert (np.diff(one.guard) <= 2 * gain.PER_DB + 1e-9).all() and (np.diff(one.guard) >= -6 * gain.PER_DB - 1e-9).all()


def _blocked(df, keys, pos, before, after, size):
    p = F.col(pos)
    return df.withColumn("_blk", F.explode(F.sequence(F.floor((p - after) / size), F.floor((p + before) / size)))), list(keys), pos, size


def test_macro_curve_sums_its_regions_without_lists(spark, monkeypatch):
    monkeypatch.setattr(gain, "materialise", lambda df: df)
    h = spark.createDataFrame([(1, k, 1.0, 100, 0.1) for k in range(9)], "track_id bigint, hop bigint, energy double, n bigint, peak double")
    e = spark.createDataFrame([(1, 4)], "track_id bigint, hop bigint")
    plan = gain.macro_curve(h, e, K, 1000, 100)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not re.search(r"collect_list\((named_)?struct|_near", plan)
