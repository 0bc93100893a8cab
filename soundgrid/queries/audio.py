"""Gain plans, sample-level kernels and the end-user jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, folds, loudness, pcm, spectra, windows
from soundgrid.plans import gain, jobs
from soundgrid.queries.levels import K, TIMELINE_SQL
from soundgrid.queries.motion import GAIN_SQL, ev_gains, ev_hops
from soundgrid.queries.registry import query, rnd
from soundgrid.queries.spans import PIECES_SQL, TRUE_PEAK_SQL, ev_pieces, piece_gain, tap_values
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, HOP, RATE, event_samples

STEP = 0.02
SIDE_SQL = EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames, (max(frame)) // 72 + 1 AS n FROM ev GROUP BY 1),
sp AS (SELECT track_id, frames, n, unnest(range(0, n)) AS cell FROM ext),
rw AS (SELECT track_id, frame // 72 AS cell, sum(pow((l + r) / 2, 2)) AS m, sum(pow((l - r) / 2, 2)) AS s FROM ev GROUP BY 1, 2),
ms AS (SELECT sp.track_id, sp.cell, n, coalesce(m, 0) / least(72, frames - sp.cell * 72) AS m, coalesce(s, 0) / least(72, frames - sp.cell * 72) AS s FROM sp LEFT JOIN rw ON rw.track_id = sp.track_id AND rw.cell = sp.cell),
tt AS (SELECT track_id, sum(m) AS pm, sum(s) AS ps, count(*) AS n FROM ms GROUP BY 1),
tg AS (SELECT *, CASE WHEN greatest(pm, ps) > 0 THEN ps / (pm + ps) END AS observed, greatest(0.001, least(0.49, coalesce(CASE WHEN greatest(pm, ps) > 0 THEN ps / (pm + ps) END, 0.12))) AS target, greatest(1e-14, (pm + ps) / n * 1e-6) AS gate FROM tt),
av AS (SELECT track_id, cell, m, s, avg(m) OVER w AS mm, avg(s) OVER w AS ss FROM ms WINDOW w AS (PARTITION BY track_id ORDER BY cell ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
id AS (SELECT av.*, target, observed, gate, pm, ps, tg.n, target / (1 - target) AS ratio, CASE WHEN mm > gate AND ss > gate THEN 0.5 * (ln(target / (1 - target)) + ln(mm) - ln(ss)) END AS ideal FROM av JOIN tg USING (track_id)),
l0 AS (SELECT *, CASE WHEN ideal IS NULL THEN 0 ELSE greatest(-24 * ln(10.0) / 20, least(12 * ln(10.0) / 20, ideal)) END AS l, ideal IS NOT NULL AND abs(ideal - greatest(-24 * ln(10.0) / 20, least(12 * ln(10.0) / 20, ideal))) > 0.001 AS lim FROM id),
l1 AS (SELECT *, avg(l) OVER (PARTITION BY track_id ORDER BY cell ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS la FROM l0),
l2 AS (SELECT *, avg(la) OVER (PARTITION BY track_id ORDER BY cell ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS level FROM l1),
gw AS (SELECT *, sum(m) OVER v AS wm, sum(s) OVER v AS ws, count(*) OVER v AS wn, max(level) OVER (PARTITION BY track_id ORDER BY cell ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS wl FROM l2 WINDOW v AS (PARTITION BY track_id ORDER BY cell ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
rq AS (SELECT *, CASE WHEN ws > gate * wn THEN least(0, greatest(-60 * ln(10.0) / 20, 0.5 * ln(greatest(1e-30, ratio * wm) / ws) - wl)) ELSE 0 END AS need FROM gw),
g0 AS (SELECT *, least(0, min(need) OVER (PARTITION BY track_id ORDER BY cell ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS g FROM rq),
g1 AS (SELECT *, min(g - ln(10.0) / 20 * 0.4 * cell) OVER (PARTITION BY track_id ORDER BY cell) + ln(10.0) / 20 * 0.4 * cell AS up FROM g0),
g2 AS (SELECT *, min(up + ln(10.0) / 20 * 1.2 * cell) OVER (PARTITION BY track_id ORDER BY cell DESC) - ln(10.0) / 20 * 1.2 * cell AS guard FROM g1)"""


def side_cells(spark, root):
    l, r = F.col("l"), F.col("r")
    c = cells.dense_cells(event_samples(spark, root), K, "frame", int(STEP * RATE), {"m": F.sum(scalar.mid(l, r) ** 2), "s": F.sum(scalar.side(l, r) ** 2)})
    return c.select("track_id", "cell", (F.col("m") / F.col("n")).alias("m"), (F.col("s") / F.col("n")).alias("s"))


@query("F1 F8 F11 J8", "WITH" + SIDE_SQL + " SELECT track_id, cell, R6(level * 20 / ln(10.0)) AS level_db, R6(guard * 20 / ln(10.0)) AS guard_db FROM g2")
def side_level_plan(spark, root):
    d = gain.side_plan(side_cells(spark, root), K, STEP)
    return d.select("track_id", "cell", rnd(F.col("level") / gain.PER_DB).alias("level_db"), rnd(F.col("guard") / gain.PER_DB).alias("guard_db"))


@query("B6 J8", "WITH" + SIDE_SQL + """,
p AS (SELECT track_id, any_value(target) AS target, any_value(observed) AS observed, any_value(pm) AS pm, any_value(ps) AS ps, any_value(gate) * any_value(n) AS gate, sum(s * exp(2 * (level + guard))) AS post, bool_or(lim) AS lim FROM g2 GROUP BY 1)
SELECT track_id, R6(target) AS target, R6(observed) AS observed, R6(post / (pm + post)) AS estimated, CASE WHEN pm + ps = 0 THEN 'silence' WHEN pm <= gate THEN 'mid_absent' WHEN ps <= gate THEN 'no_usable_side' WHEN lim THEN 'range_limited' ELSE '' END AS notice FROM p""")
def side_level_report(spark, root):
    d = gain.side_report(gain.side_plan(side_cells(spark, root), K, STEP), K)
    return d.select("track_id", *[rnd(c).alias(c) for c in ("target", "observed", "estimated")], "notice")


@query("J13", "WITH" + PIECES_SQL + f""",
taps(p, t, c) AS (VALUES {tap_values()}),
gg AS (SELECT ev.track_id, frame, l / 8 AS l, r / 8 AS r, CASE WHEN start IS NULL THEN 0 WHEN shape = 'HOLD' THEN start_db ELSE start_db + (end_db - start_db) * (3 * pow((frame - start) / ("end" - start), 2) - 2 * pow((frame - start) / ("end" - start), 3)) END AS g
  FROM ev LEFT JOIN pc ON ev.track_id = pc.track_id AND frame >= start AND frame < "end"),
sh AS (SELECT unnest(range(0, 22)) / 20.0::DOUBLE AS share),
sc AS (SELECT track_id, share, frame, sum(l * k) AS l, sum(r * k) AS r FROM (SELECT track_id, share, frame, l, r, CASE WHEN share > 1.01 THEN 1 WHEN g > 0 THEN pow(10, g * share / 20) ELSE pow(10, g / 20) END AS k FROM gg CROSS JOIN sh) GROUP BY 1, 2, 3),
la AS (SELECT track_id, max(frame) AS lastf FROM ev GROUP BY 1),
y AS (SELECT track_id, share, frame + t AS f, p, abs(sum(l * c::DOUBLE)) AS yl, abs(sum(r * c::DOUBLE)) AS yr FROM sc CROSS JOIN taps GROUP BY 1, 2, 3, 4),
ip AS (SELECT track_id, share, max(greatest(yl, yr)) AS v FROM y JOIN la USING (track_id) WHERE f <= lastf + 6 GROUP BY 1, 2),
tp AS (SELECT track_id, share, greatest(max(greatest(abs(l), abs(r))), max(v)) AS tp FROM sc JOIN ip USING (track_id, share) GROUP BY 1, 2),
ce AS (SELECT track_id, least(1, tp * pow(10, 0.1::DOUBLE / 20)) AS ceiling FROM tp WHERE share > 1.01)
SELECT tp.track_id, R9(ceiling) AS ceiling, max(share) FILTER (tp <= ceiling) AS share, R9(max(tp) FILTER (share = 1.0)) AS planned_peak FROM tp JOIN ce USING (track_id) WHERE share < 1.01 GROUP BY 1, ceiling""")
def true_peak_safety(spark, root):
    d = piece_gain(event_samples(spark, root), ev_pieces(spark, root)).select("track_id", "frame", (F.col("l") / 8).alias("l"), (F.col("r") / 8).alias("r"), "gain_db")
    out = gain.safe_scale(materialise(d), K, "gain_db", ["l", "r"])
    return out.select("track_id", rnd("ceiling", 9).alias("ceiling"), "share", rnd("planned_peak", 9).alias("planned_peak"))


def gated_sql(tl: str, out: str) -> str:
    return f"""
{out}_a AS (SELECT track_id, -0.691 + 10 * log10(avg(m_power)) - 10 AS gate FROM {tl} WHERE m_power > 0 AND -0.691 + 10 * log10(m_power) > -70 GROUP BY 1),
{out} AS (SELECT track_id, -0.691 + 10 * log10(avg(m_power)) AS lufs FROM {tl} JOIN {out}_a USING (track_id) WHERE m_power > 0 AND -0.691 + 10 * log10(m_power) > greatest(-70, gate) GROUP BY 1)"""


@query("J16", "WITH" + TIMELINE_SQL + """,
raw2 AS (SELECT track_id, frame // 360 AS hop, sum(l * l + r * r * 0.7 * 0.7) AS energy FROM ev GROUP BY 1, 2),
hops2 AS (SELECT s.track_id, s.hop, least(360, s.frames - s.hop * 360) AS n, coalesce(energy, 0) AS energy FROM spine s LEFT JOIN raw2 USING (track_id, hop)),
tl2 AS (SELECT track_id, hop, CASE WHEN sum(n) OVER m = 1440 THEN sum(energy) OVER m / 1440 END AS m_power FROM hops2 WINDOW m AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),""" + gated_sql("tl", "bf") + "," + gated_sql("tl2", "af") + """,
pk AS (SELECT track_id, max(greatest(abs(l), abs(r) * 0.7)) AS peak FROM ev GROUP BY 1),
g AS (SELECT track_id, greatest(-24, least(24, bf.lufs - af.lufs)) AS g, peak FROM bf JOIN af USING (track_id) JOIN pk USING (track_id))
SELECT track_id, R6(CASE WHEN peak * pow(10, g / 20) > 1 THEN -0.1 - 20 * log10(peak) ELSE g END) AS gain_db FROM g""")
def loudness_match(spark, root):
    """Gain that makes a narrowed version as loud as the original."""
    ev = event_samples(spark, root)
    after = ev.withColumn("r", F.col("r") * 0.7)
    a = loudness.integrated(loudness.timeline(ev, K, HOP), K).select("track_id", F.col("lufs").alias("before"))
    b = loudness.integrated(loudness.timeline(after, K, HOP), K).select("track_id", F.col("lufs").alias("after"))
    peak = after.groupBy("track_id").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"))
    d = a.join(b, "track_id").join(peak, "track_id").where("before IS NOT NULL AND after IS NOT NULL")
    return d.select("track_id", rnd(gain.match_gain_db(F.col("before"), F.col("after"), F.col("peak"))).alias("gain_db"))


REPORT_SQL = TIMELINE_SQL + "," + gated_sql("tl", "ig") + """,
mx AS (SELECT track_id, max(m_lufs) AS momentary, max(s_lufs) AS short_term FROM lv GROUP BY 1),
lg AS (SELECT track_id, -0.691 + 10 * log10(avg(s_power)) - 20 AS gate FROM lv WHERE s_lufs > -70 GROUP BY 1),
lk AS (SELECT track_id, s_lufs, row_number() OVER (PARTITION BY track_id ORDER BY s_lufs) - 1 AS rk, count(*) OVER (PARTITION BY track_id) AS n FROM lv JOIN lg USING (track_id) WHERE s_lufs > -70 AND s_lufs >= gate),
lr AS (SELECT track_id, max(s_lufs) FILTER (rk = floor((n - 1) * 0.95::DOUBLE + 0.5::DOUBLE)) - max(s_lufs) FILTER (rk = floor((n - 1) * 0.10::DOUBLE + 0.5::DOUBLE)) AS lra FROM lk GROUP BY 1),
""" + TRUE_PEAK_SQL[len(EV_SQL) + 2:] + """,
sm AS (SELECT track_id, max(frame) + 1 AS frames, sum(l * l) AS ll, sum(r * r) AS rr, sum(l * r) AS lr, sum(pow((l + r) / 2, 2)) AS m, sum(pow((l - r) / 2, 2)) AS s FROM ev GROUP BY 1)"""


@query("E1 E2 E3 E4 E5 M1", "WITH" + REPORT_SQL + """
SELECT track_id, sm.frames, R6(ig.lufs) AS integrated, R6(momentary) AS momentary, R6(short_term) AS short_term, R6(lra) AS lra, R6(20 * log10(true_peak)) AS true_peak_db,
  R6(CASE WHEN sqrt(ll * rr) > 1e-12 THEN sm.lr / sqrt(ll * rr) ELSE 1 END) AS correlation, R6(10 * log10(m / sm.frames)) AS mid_db, R6(10 * log10(s / sm.frames)) AS side_db
FROM sm LEFT JOIN ig USING (track_id) LEFT JOIN mx USING (track_id) LEFT JOIN lr USING (track_id) LEFT JOIN tp USING (track_id)""")
def output_report(spark, root):
    d = jobs.output_report(event_samples(spark, root), K, HOP)
    return d.select("track_id", "frames", *[rnd(c).alias(c) for c in ("integrated", "momentary", "short_term", "lra", "true_peak_db", "correlation")],
                    rnd(10 * F.log10("mid_power")).alias("mid_db"), rnd(10 * F.log10("side_power")).alias("side_db"))


@query("A6 A7 B11 M2", "WITH" + REPORT_SQL + """
SELECT track_id, 'track_' || track_id || '.wav' AS target, R9(least(pow(10, -1 / 20.0::DOUBLE) / true_peak, pow(10, 24 / 20.0::DOUBLE))) AS gain, CASE WHEN ig.lufs IS NULL THEN 'no_loudness' END AS failure FROM sm LEFT JOIN ig USING (track_id) LEFT JOIN tp USING (track_id)""")
def batch_plan(spark, root):
    r = jobs.output_report(event_samples(spark, root), K, HOP).withColumn("name", F.concat(F.lit("track_"), F.col("track_id").cast("string")))
    d = jobs.batch_plan(r, K, "name", -1.0)
    return d.withColumn("gain", rnd("gain", 9))


# --- sample-level kernels: checked against numpy in the tests ---------------------------------

@query("E6 F9 M1 N1 N3")
def output_report_weighted(spark, root):
    """The report with K-weighted loudness from the sample-level filter."""
    return jobs.output_report(event_samples(spark, root), K, HOP, RATE)


@query("D4 E7 E8 N2")
def long_term_spectrum(spark, root):
    ch = pcm.chunks(event_samples(spark, root), K, 256)
    s = pcm.long_term_spectrum(pcm.stft_frames(ch, K, 4), K, 256, 4)
    return spectra.project(materialise(s), K, spectra.Grid(float(RATE), 1024, 20.0, 1800.0, 128))


def ev_frames(spark, root):
    return pcm.stft_frames(pcm.chunks(event_samples(spark, root), K, 1024), K, 4)


def ev_tone_gains(spark, root):
    """Per-frame band gains (arrays) towards a -3 dB per octave slope."""
    return gain.tone_correction(pcm.band_levels(ev_frames(spark, root), K, 1024, 4, RATE), K, "frame", -3.0, RATE / 1024)


@query("E23 F10 J9")
def tone_correction(spark, root):
    """Per-frame band gains towards a -3 dB per octave slope."""
    return ev_tone_gains(spark, root).select("track_id", "frame", F.posexplode("gain_db").alias("band", "gain_db"))


@query("B13 G14", None)
def correction_lookup(spark, root):
    """Correction at the time and frequency of each purchase: nearest frame, linear between bands."""
    ev = event_samples(spark, root)
    # The last frame starts in the last chunk, three hops before its end.
    top = ev.groupBy("track_id").agg((F.expr("max(frame) div 1024") + 3).alias("tf"))
    q = ev.where("event_type = 'purchase'").join(top, "track_id")
    q = q.select("track_id", "event_id", F.least(F.col("tf"), F.floor(F.col("frame") / 1024 + 1)).alias("frame"), (100 + F.abs("l") * 300).alias("hz"))
    d = q.join(ev_tone_gains(spark, root), ["track_id", "frame"])
    pos = F.least((F.size("gain_db") - 1).cast("double"), F.greatest(F.lit(0.0), 12 * F.log2(F.col("hz") / 20)))
    band = F.floor(pos).cast("int")
    low, part = F.get("gain_db", band), pos - F.floor(pos)
    return d.select("track_id", "event_id", (low * (1 - part) + F.coalesce(F.get("gain_db", band + 1), low) * part).alias("gain_db"))


@query("E24")
def band_peaks(spark, root):
    return pcm.band_peaks(ev_frames(spark, root), K, 1024, 4, RATE, (120.0, 1000.0, 6000.0))


@query("E19 J11", "WITH RECURSIVE" + EV_SQL + """,
q AS MATERIALIZED (SELECT track_id, frame, max(greatest(abs(l), abs(r))) AS a, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM ev GROUP BY 1, 2),
f AS (SELECT track_id, i, frame, a * (1 - exp(-1 / (3600 * 0.06::DOUBLE))) AS env FROM q WHERE i = 1
  UNION ALL SELECT q.track_id, q.i, q.frame, q.a + CASE WHEN q.a > f.env * pow(exp(-1 / (3600 * 0.3::DOUBLE)), q.frame - f.frame - 1) THEN exp(-1 / (3600 * 0.06::DOUBLE)) ELSE exp(-1 / (3600 * 0.3::DOUBLE)) END * (f.env * pow(exp(-1 / (3600 * 0.3::DOUBLE)), q.frame - f.frame - 1) - q.a)
  FROM f JOIN q ON q.track_id = f.track_id AND q.i = f.i + 1),
g AS (SELECT track_id, max(env) AS sustain FROM f GROUP BY 1), p AS (SELECT track_id, max(a) AS peak FROM q GROUP BY 1),
h AS (SELECT track_id, peak, sustain, greatest(0, 20 * log10(peak / sustain)) AS hr FROM p JOIN g USING (track_id))
SELECT track_id, peak, R9(sustain) AS sustain, R6(hr) AS headroom_db, R6(peak * pow(10, -least(hr, 2) / 20)) AS ceiling FROM h""")
def peak_headroom(spark, root):
    """Headroom of the peaks over the sustained level, and the ceiling for -2 dB."""
    s = event_samples(spark, root).select("track_id", "frame", F.greatest(F.abs("l"), F.abs("r")).alias("a"))
    d = folds.headroom(s, K, "frame", "a", RATE)
    ceiling = gain.peak_ceiling(F.col("peak"), F.col("headroom_db"), -2.0)
    return d.select("track_id", "peak", rnd("sustain", 9).alias("sustain"), rnd("headroom_db").alias("headroom_db"), rnd(ceiling).alias("ceiling"))


@query("F8 F10", "WITH RECURSIVE" + GAIN_SQL + """,
h AS MATERIALIZED (SELECT track_id, hop, min(gain) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS t FROM gn),
f AS (SELECT track_id, hop, t + CASE WHEN t < 1 THEN exp(-1 / (10 * 0.05::DOUBLE)) ELSE exp(-1 / (10 * 0.5::DOUBLE)) END * (1 - t) AS env FROM h WHERE hop = 0
  UNION ALL SELECT h.track_id, h.hop, h.t + CASE WHEN h.t < f.env THEN exp(-1 / (10 * 0.05::DOUBLE)) ELSE exp(-1 / (10 * 0.5::DOUBLE)) END * (f.env - h.t) FROM f JOIN h ON h.track_id = f.track_id AND h.hop = f.hop + 1)
SELECT track_id, hop, R9(env) AS smooth FROM f""")
def gain_follower(spark, root):
    """Look-ahead minimum, then attack/release smoothing, over 100 ms gains."""
    g = windows.forward_min(ev_gains(spark, root), K, "hop", "gain", 2, "held")
    return folds.smooth_gain(g, K, "hop", "held", 10.0, 0.05, 0.5, "smooth").withColumn("smooth", rnd("smooth", 9))


@query("F12", "WITH RECURSIVE" + GAIN_SQL + """,
n AS (SELECT track_id, max(hop) + 1 AS n FROM gn GROUP BY 1),
x AS (SELECT track_id, n, unnest(range(-8, n + 4)) AS i FROM n),
d AS (SELECT x.track_id, x.n, i, coalesce(gain, 1) AS g FROM x LEFT JOIN gn ON gn.track_id = x.track_id AND gn.hop = i),
h AS MATERIALIZED (SELECT track_id, n, i, min(g) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM d),
f AS (SELECT track_id, n, i, 1.0::DOUBLE AS env FROM h WHERE i = -8
  UNION ALL SELECT h.track_id, h.n, h.i, least(h.held, f.env + (1 - exp(-1 / 10.0::DOUBLE)) * (h.held - f.env)) FROM f JOIN h ON h.track_id = f.track_id AND h.i = f.i + 1),
a AS (SELECT track_id, n, i, avg(env) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM f),
b AS (SELECT track_id, n, i - 4 AS hop, avg(v) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM a)
SELECT b.track_id, b.hop, R9(greatest(0, least(gain, least(1, v)))) AS gain FROM b JOIN gn ON gn.track_id = b.track_id AND gn.hop = b.hop""")
def limiter_envelope(spark, root):
    """Look-ahead limiter gain for a ceiling of one half."""
    return folds.limiter(ev_hops(spark, root), K, "hop", "peak", 0.5, attack=4, release=10, out="gain").withColumn("gain", rnd("gain", 9))


@query("B17 C4 F2 F3 F5 J7")
def macro_curve(spark, root):
    from soundgrid.queries.motion import level_steps

    edges = materialise(level_steps(spark, root).select("track_id", "hop"))
    return gain.macro_curve(ev_hops(spark, root), edges, K, RATE, HOP)


@query("J6 M5")
def ramp_pieces(spark, root):
    """Gain pieces that lift the segments cut at the sign-ups half-way to the loudest one."""
    from soundgrid.queries.bodies import descriptors
    from soundgrid.queries.forms import RATE as SLOW

    d = descriptors(spark, root)
    top = d.groupBy("track_id").agg(F.max("lufs").alias("top"))
    d = d.join(top, "track_id").withColumns({"protected": F.col("lufs").isNull(), "weighted_db": F.coalesce((F.col("top") - F.col("lufs")) / 2, F.lit(0.0))})
    return gain.ramps(d, K, SLOW)
