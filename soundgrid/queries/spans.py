"""Intervals, as-of lookups, gain curves, peaks."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import quantiles, scalar
from soundgrid.operators import cells, intervals, joins, peaks, segments, windows
from soundgrid.queries.levels import K
from soundgrid.queries.motion import GAIN_SQL, HOPS_SQL, ev_gains, ev_hops
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, HOP, event_samples

IV_SQL = """,
iv AS (SELECT track_id, frame AS start, frame + 60 + CAST(floor(l * 2000) AS BIGINT) AS "end" FROM ev WHERE event_type = 'purchase')"""


def merge_sql(src: str, out: str) -> str:
    return f""",
{out}_a AS (SELECT track_id, start, "end", max("end") OVER (PARTITION BY track_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{out}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM {out}_a),
{out} AS (SELECT track_id, min(start) AS start, max("end") AS "end" FROM {out}_b GROUP BY track_id, g)"""


def ev_intervals(spark, root):
    """Each purchase protects a stretch whose length follows its value."""
    e = event_samples(spark, root).where("event_type = 'purchase'")
    return e.select("track_id", F.col("frame").alias("start"), (F.col("frame") + 60 + F.floor(F.col("l") * 2000)).alias("end"))


EX_SQL = EV_SQL + IV_SQL + merge_sql("iv", "ex")


def ev_exclusions(spark, root):
    return materialise(intervals.merge(ev_intervals(spark, root), K))


@query("I2", "WITH" + EX_SQL + """ SELECT track_id, start, "end", count(*) OVER (PARTITION BY track_id) AS regions, count(*) OVER (PARTITION BY track_id) <= 256 AS allowed FROM ex""")
def exclusion_merge(spark, root):
    ex = ev_exclusions(spark, root)
    return ex.join(intervals.within_limit(ex, K), K)


@query("B21 I3", "WITH" + EX_SQL + """,
c0 AS (SELECT track_id, greatest(7200, start) - 7200 AS start, least(28800, "end") - 7200 AS "end" FROM ex WHERE least(28800, "end") > greatest(7200, start)),
d1 AS (SELECT track_id, CASE WHEN start <= 7200 THEN start ELSE greatest(7200, start - 21600) END AS start, CASE WHEN "end" <= 7200 THEN "end" ELSE greatest(7200, "end" - 21600) END AS "end" FROM ex),
d0 AS (SELECT * FROM d1 WHERE "end" > start)""" + merge_sql("c0", "c") + merge_sql("d0", "d") + """
SELECT 'crop' AS edit, * FROM c UNION ALL SELECT 'delete', * FROM d""")
def exclusion_crop_delete(spark, root):
    ex = ev_exclusions(spark, root)
    lo, hi = F.lit(7200).cast("bigint"), F.lit(28800).cast("bigint")
    a = intervals.crop(ex, K, lo, hi).withColumn("edit", F.lit("crop"))
    return a.unionByName(intervals.delete(ex, K, lo, hi).withColumn("edit", F.lit("delete")))


@query("B22", "WITH" + EX_SQL + """,
r AS (SELECT track_id, CAST(floor(start * 96000.0::DOUBLE / 44100 + 0.5) AS BIGINT) AS start,
   greatest(CAST(floor(start * 96000.0::DOUBLE / 44100 + 0.5) AS BIGINT) + 1, CAST(floor("end" * 96000.0::DOUBLE / 44100 + 0.5) AS BIGINT)) AS "end" FROM ex)""" + merge_sql("r", "m") + " SELECT * FROM m")
def exclusion_reclock(spark, root):
    return intervals.reclock(ev_exclusions(spark, root), K, 44100, 96000)


@query("B8 G7", "WITH" + EX_SQL + """,
pt AS (SELECT track_id, event_id, frame FROM ev WHERE event_type = 'click'),
d AS (SELECT pt.track_id, event_id, frame, min(CASE WHEN frame >= start AND frame < "end" THEN -1.0 WHEN frame < start THEN start - frame ELSE frame - "end" END) AS dist
      FROM pt LEFT JOIN ex ON pt.track_id = ex.track_id GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN dist IS NULL THEN 1 ELSE greatest(0, least(1, (dist - 90) / 1440.0)) END AS t FROM d)
SELECT track_id, event_id, frame, R9(CASE WHEN dist < 0 THEN 0 ELSE t * t * (3 - 2 * t) END) AS weight FROM t""")
def exclusion_weight(spark, root):
    pt = event_samples(spark, root).where("event_type = 'click'").select("track_id", "event_id", "frame")
    d = intervals.exclusion_weight(pt, ev_exclusions(spark, root), K, "frame", 1440.0, 90.0, "weight")
    return d.select("track_id", "event_id", "frame", rnd("weight", 9).alias("weight"))


PIECES_SQL = EX_SQL + """,
pc AS (SELECT track_id, start, "end", CASE WHEN start % 2 = 0 THEN 'HOLD' ELSE 'SMOOTHSTEP' END AS shape,
   -6 + ("end" - start) % 900 / 100.0::DOUBLE AS start_db, CASE WHEN start % 2 = 0 THEN -6 + ("end" - start) % 900 / 100.0::DOUBLE ELSE -6 + "end" % 900 / 100.0::DOUBLE END AS end_db FROM ex)"""


def ev_pieces(spark, root):
    """Gain pieces on the merged stretches: -6..+3 dB, hold or smoothstep."""
    s, e = F.col("start"), F.col("end")
    hold = s % 2 == 0
    a, b = -6 + (e - s) % 900 / 100.0, -6 + e % 900 / 100.0
    return ev_exclusions(spark, root).select(
        "track_id", "start", "end", F.when(hold, "HOLD").otherwise("SMOOTHSTEP").alias("shape"),
        a.alias("start_db"), F.when(hold, a).otherwise(b).alias("end_db"))


@query("B17 G5", "WITH" + PIECES_SQL + """,
pt AS (SELECT track_id, event_id, frame FROM ev)
SELECT pt.track_id, event_id, frame, R9(CASE WHEN start IS NULL THEN 0 WHEN shape = 'HOLD' THEN start_db ELSE
  start_db + (end_db - start_db) * (3 * pow((frame - start) / ("end" - start), 2) - 2 * pow((frame - start) / ("end" - start), 3)) END) AS gain_db
FROM pt LEFT JOIN pc ON pt.track_id = pc.track_id AND frame >= start AND frame < "end" """)
def gain_piece_lookup(spark, root):
    pt = event_samples(spark, root).select("track_id", "event_id", "frame")
    return piece_gain(pt, ev_pieces(spark, root)).select("track_id", "event_id", "frame", rnd("gain_db", 9).alias("gain_db"))


def piece_gain(points, pieces):
    marks = pieces.select("track_id", F.col("start").alias("_at"), F.struct("start", "end", "start_db", "end_db", "shape").alias("p"))
    d = joins.asof(points, marks, K, "frame", "_at", "p", before="piece")
    g = scalar.piece_gain_db(F.col("frame"), *[F.col(f"piece.{c}") for c in ("start", "end", "start_db", "end_db", "shape")])
    return d.withColumn("gain_db", F.when(F.col("frame") < F.col("piece.end"), g).otherwise(F.lit(0.0))).drop("piece")


@query("B17 G6", "WITH" + GAIN_SQL + """,
nx AS (SELECT track_id, hop, gain, lead(gain) OVER (PARTITION BY track_id ORDER BY hop) AS nxt FROM gn)
SELECT ev.track_id, event_id, frame, R9(CASE WHEN nxt IS NULL THEN gain ELSE gain + (nxt - gain) * (frame / 360.0::DOUBLE - frame // 360) END) AS gain
FROM ev JOIN nx ON ev.track_id = nx.track_id AND nx.hop = frame // 360""")
def dense_gain_lookup(spark, root):
    pt = event_samples(spark, root).select("track_id", "event_id", "frame")
    return dense_gain(pt, ev_gains(spark, root)).select("track_id", "event_id", "frame", rnd("gain", 9).alias("gain"))


def dense_gain(points, gains, hop=HOP):
    """Linear interpolation on a dense curve: two equality joins on the hop number."""
    g = gains.select("track_id", "hop", "gain")
    both = g.join(g.select("track_id", (F.col("hop") - 1).alias("hop"), F.col("gain").alias("next")), ["track_id", "hop"], "left")
    d = points.withColumn("hop", F.expr(f"frame div {hop}")).join(both, ["track_id", "hop"], "left")
    part = F.col("frame") / hop - F.col("hop")
    return d.withColumn("gain", F.coalesce(F.col("gain") + (F.col("next") - F.col("gain")) * part, F.col("gain"), F.lit(1.0))).drop("next", "hop")


@query("J12 B17", "WITH" + PIECES_SQL + """
SELECT ev.track_id, event_id, R9(l * pow(10, g / 20)) AS l, R9(r * pow(10, g / 20)) AS r FROM
 (SELECT ev.*, CASE WHEN start IS NULL THEN 0 WHEN shape = 'HOLD' THEN start_db ELSE
  start_db + (end_db - start_db) * (3 * pow((frame - start) / ("end" - start), 2) - 2 * pow((frame - start) / ("end" - start), 3)) END AS g
  FROM ev LEFT JOIN pc ON ev.track_id = pc.track_id AND frame >= start AND frame < "end") ev""")
def apply_gain(spark, root):
    d = piece_gain(event_samples(spark, root), ev_pieces(spark, root))
    g = scalar.gain_from_db(F.col("gain_db"))
    return d.select("track_id", "event_id", rnd(F.col("l") * g, 9).alias("l"), rnd(F.col("r") * g, 9).alias("r"))


@query("G4", "WITH" + GAIN_SQL + """,
o AS (SELECT track_id, event_id, (frame - 720) // 360 AS lo, (frame + 1440) // 360 AS hi FROM ev WHERE event_type = 'click' AND frame >= 720)
SELECT o.track_id, event_id, R9(min(gain)) AS gain, count(*) AS cells FROM o JOIN gn ON gn.track_id = o.track_id AND hop BETWEEN lo AND hi GROUP BY 1, 2""")
def onset_cells(spark, root):
    o = event_samples(spark, root).where("event_type = 'click' AND frame >= 720").select(
        "track_id", "event_id", F.expr("(frame - 720) div 360").alias("lo"), F.expr("(frame + 1440) div 360").alias("hi"))
    g = ev_gains(spark, root).select("track_id", "hop", "gain")
    return joins.range_join(o, g, K, "lo", "hi", "hop", 64).groupBy("track_id", "event_id").agg(
        rnd(F.min("gain"), 9).alias("gain"), F.count("*").alias("cells"))


@query("F21", "WITH" + GAIN_SQL + IV_SQL + """,
q AS (SELECT DISTINCT track_id, start, "end", start // 360 AS lo, "end" // 360 AS hi FROM iv)
SELECT q.track_id, start, "end", R6(greatest(-6, least(0, 20 * log10(greatest(min(gain), 1e-6))))) AS deepest_db
FROM q JOIN gn ON gn.track_id = q.track_id AND hop BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def deepest_reduction(spark, root):
    q = ev_intervals(spark, root).distinct().withColumns({"lo": F.expr("start div 360"), "hi": F.expr("end div 360")})
    g = ev_gains(spark, root).select("track_id", "hop", "gain")
    low = F.greatest(F.min("gain"), F.lit(1e-6))
    return joins.range_join(q, g, K, "lo", "hi", "hop", 64).groupBy("track_id", "start", "end").agg(
        rnd(scalar.clamp(20 * F.log10(low), -6.0, 0.0)).alias("deepest_db"))


@query("B9", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
f AS (SELECT ev.track_id, event_id, CASE event_type WHEN 'view' THEN 'linear' WHEN 'click' THEN 'exponential' WHEN 'signup' THEN 'logarithmic' ELSE 'scurve' END AS curve,
   CASE WHEN frame < 14400 THEN frame / 14400.0::DOUBLE ELSE 1 END AS u,
   CASE WHEN frame >= greatest(0, frames - 10800) THEN greatest(0, 1 - (frame - greatest(0, frames - 10800)) / (frames - greatest(0, frames - 10800))) ELSE 1 END AS d
  FROM ev JOIN ext USING (track_id))
SELECT track_id, event_id, R9((CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 WHEN curve = 'exponential' THEN u * u WHEN curve = 'logarithmic' THEN sqrt(u) WHEN curve = 'scurve' THEN u * u * (3 - 2 * u) ELSE u END)
  * (CASE WHEN d <= 0 THEN 0 WHEN d >= 1 THEN 1 WHEN curve = 'exponential' THEN d * d WHEN curve = 'logarithmic' THEN sqrt(d) WHEN curve = 'scurve' THEN d * d * (3 - 2 * d) ELSE d END)) AS factor FROM f""")
def fade(spark, root):
    ev = event_samples(spark, root)
    curve = F.when(F.col("event_type") == "view", "linear").when(F.col("event_type") == "click", "exponential").when(
        F.col("event_type") == "signup", "logarithmic").otherwise("scurve")
    d = ev.join(cells.extents(ev, K, "frame"), "track_id")
    f = scalar.fade_factor(F.col("frame"), F.col("frames"), F.lit(14400), F.lit(10800), curve)
    return d.select("track_id", "event_id", rnd(f, 9).alias("factor"))


@query("B10", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1)
SELECT ev.track_id, event_id, frame - 7200 AS frame, frames - 7200 - 33600 AS frames, CASE WHEN 7200 + 33600 >= frames THEN 'nothing_left' END AS failure
FROM ev JOIN ext USING (track_id) WHERE 7200 + 33600 >= frames OR (frame >= 7200 AND frame < frames - 33600)""")
def trim(spark, root):
    from soundgrid.plans.edits import trim as cut

    ev = event_samples(spark, root)
    d = cut(ev, cells.extents(ev, K, "frame"), K, 7200, 33600)
    return d.select("track_id", "event_id", "frame", "frames", "failure")


@query("B11 B23", "WITH" + EV_SQL + """,
p AS (SELECT track_id, max(greatest(abs(l), abs(r))) AS peak FROM ev GROUP BY 1)
SELECT track_id, peak, R9(CASE WHEN peak <= 0 THEN 1 ELSE least(pow(10, -1 / 20.0::DOUBLE) / peak, pow(10, 24 / 20.0::DOUBLE)) END) AS gain,
  R9(CASE WHEN peak > 1 THEN pow(10, -0.1::DOUBLE / 20) / peak ELSE 1 END) AS safety_gain, R9(least(1, 0.9::DOUBLE / peak)) AS recheck_scale FROM p""")
def normalize_gain(spark, root):
    p = event_samples(spark, root).groupBy("track_id").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"))
    peak = F.col("peak")
    return p.select("track_id", "peak", rnd(scalar.normalise_gain(peak, -1.0), 9).alias("gain"),
                    rnd(scalar.safety_gain(peak), 9).alias("safety_gain"), rnd(scalar.ceiling_scale(peak, 0.9), 9).alias("recheck_scale"))


def tap_values() -> str:
    return ", ".join(f"({p}, {t}, {v})" for p, row in enumerate(peaks.TRUE_PEAK_PHASES) for t, v in enumerate(row))


TRUE_PEAK_SQL = EV_SQL + f""",
taps(p, t, c) AS (VALUES {tap_values()}),
mg AS (SELECT track_id, frame, sum(l) AS l, sum(r) AS r FROM ev GROUP BY 1, 2),
la AS (SELECT track_id, max(frame) AS lastf FROM ev GROUP BY 1),
y AS (SELECT track_id, frame + t AS f, p, abs(sum(l * c::DOUBLE)) AS yl, abs(sum(r * c::DOUBLE)) AS yr FROM mg CROSS JOIN taps GROUP BY 1, 2, 3),
ip AS (SELECT track_id, max(greatest(yl, yr)) AS v FROM y JOIN la USING (track_id) WHERE f <= lastf + 6 GROUP BY 1),
tp AS (SELECT track_id, max(greatest(abs(l), abs(r))) AS sample_peak, greatest(max(greatest(abs(l), abs(r))), max(v)) AS true_peak FROM mg JOIN ip USING (track_id) GROUP BY 1)"""


@query("E5", "WITH" + TRUE_PEAK_SQL + """
SELECT track_id, R9(sample_peak) AS sample_peak, R9(true_peak) AS true_peak, R6(20 * log10(true_peak)) AS true_peak_db FROM tp""")
def true_peak(spark, root):
    d = peaks.true_peak(event_samples(spark, root), K, "frame", ["l", "r"])
    return d.select("track_id", rnd("sample_peak", 9).alias("sample_peak"), rnd("true_peak", 9).alias("true_peak"),
                    rnd(scalar.amplitude_db(F.col("true_peak"))).alias("true_peak_db"))


@query("B23 J17", "WITH" + TRUE_PEAK_SQL.replace("sum(l) AS l, sum(r) AS r FROM ev", "sum(l * 1.25) AS l, sum(r * 1.25) AS r FROM ev") + """
SELECT track_id, R9(true_peak) AS first_pass, R9(least(1, 0.8::DOUBLE / true_peak)) AS scale, R6(20 * log10(least(1, 0.8::DOUBLE / true_peak))) AS trim_db,
  R9(true_peak * least(1, 0.8::DOUBLE / true_peak)) AS second_pass, true_peak * least(1, 0.8::DOUBLE / true_peak) <= 0.8 * (1 + 1e-7) AS verified FROM tp""")
def ceiling_check(spark, root):
    """Peak of samples times gain, one trim to the ceiling, and the second pass that proves it."""
    s = event_samples(spark, root).withColumns({"l": F.col("l") * 1.25, "r": F.col("r") * 1.25})
    first = peaks.true_peak(s, K, "frame", ["l", "r"]).select("track_id", F.col("true_peak").alias("first"))
    scale = scalar.ceiling_scale(F.col("first"), 0.8)
    trimmed = s.join(first, "track_id").withColumns({"l": F.col("l") * scale, "r": F.col("r") * scale})
    second = peaks.true_peak(trimmed, K, "frame", ["l", "r"]).select("track_id", F.col("true_peak").alias("second"))
    return first.join(second, "track_id").select(
        "track_id", rnd("first", 9).alias("first_pass"), rnd(scale, 9).alias("scale"), rnd(20 * F.log10(scale)).alias("trim_db"),
        rnd("second", 9).alias("second_pass"), (F.col("second") <= 0.8 * (1 + 1e-7)).alias("verified"))


CLIP_SQL = EV_SQL + """,
h AS (SELECT track_id, frame // 1024 AS hop, max(greatest(l, r, 0)) AS pos, max(greatest(-l, -r, 0)) AS neg FROM ev GROUP BY 1, 2),
pk AS (SELECT track_id, max(greatest(pos, neg)) AS peak FROM h GROUP BY 1)"""


@query("D5 E25 J10", "WITH" + CLIP_SQL + """
SELECT track_id, hop, R9(pos) AS positive, R9(neg) AS negative, R9(peak * pow(10, -3 / 20.0::DOUBLE)) AS ceiling,
  R6(CASE WHEN greatest(pos, neg) > 0 THEN 20 * log10(least(greatest(pos, neg), peak * pow(10, -3 / 20.0::DOUBLE)) / greatest(pos, neg)) ELSE 0 END) AS reduction_db
FROM h JOIN pk USING (track_id)""")
def hard_clip_ceiling(spark, root):
    zero = F.lit(0.0)
    h = cells.cells(event_samples(spark, root), K, "frame", 1024, {
        "positive": F.max(F.greatest("l", "r", zero)), "negative": F.max(F.greatest(-F.col("l"), -F.col("r"), zero))}, "hop")
    pk = h.groupBy("track_id").agg(F.max(F.greatest("positive", "negative")).alias("peak"))
    before = F.greatest("positive", "negative")
    ceiling = peaks.hard_clip_ceiling(F.col("peak"), F.lit(3.0))
    return h.join(pk, "track_id").select(
        "track_id", "hop", rnd("positive", 9).alias("positive"), rnd("negative", 9).alias("negative"), rnd(ceiling, 9).alias("ceiling"),
        rnd(peaks.reduction_db(before, F.least(before, ceiling))).alias("reduction_db"))


@query("D5 D7", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
c AS (SELECT track_id, col, (col * frames) // 100 AS start, ((col + 1) * frames + 99) // 100 AS "end" FROM ext, (SELECT CAST(unnest(range(100)) AS INTEGER) AS col))
SELECT c.track_id, col, start, "end", R9(coalesce(max(greatest(abs(l), abs(r))), 0)) AS peak
FROM c LEFT JOIN ev ON ev.track_id = c.track_id AND frame >= start AND frame < "end" GROUP BY 1, 2, 3, 4""")
def peak_index_columns(spark, root):
    ev = event_samples(spark, root)
    d = peaks.waveform_columns(ev, cells.extents(ev, K, "frame"), K, "frame", F.greatest(F.abs("l"), F.abs("r")), 100)
    return d.withColumn("peak", rnd("peak", 9))


@query("E18", "WITH" + EV_SQL + """,
o AS (SELECT track_id, event_id, frame FROM ev WHERE event_type = 'click'),
p AS (SELECT o.track_id, o.event_id, 20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-6)) AS db FROM o JOIN ev e ON e.track_id = o.track_id AND e.frame >= o.frame AND e.frame < o.frame + 108 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY db) - 1 AS rk, count(*) OVER (PARTITION BY track_id) AS n FROM p),
m AS (SELECT track_id, max(db) FILTER (rk = n // 2) AS med FROM r GROUP BY 1)
SELECT track_id, event_id, R6(db) AS peak_db, R6(greatest(0, db - med)) AS excess_db FROM p JOIN m USING (track_id)""")
def onset_excess(spark, root):
    ev = event_samples(spark, root)
    o = ev.where("event_type = 'click'").select("track_id", "event_id", F.col("frame").alias("lo"), (F.col("frame") + 107).alias("hi"))
    s = ev.groupBy("track_id", "frame").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("a"))
    p = joins.range_join(o.select("track_id", "lo", "hi").distinct(), s, K, "lo", "hi", "frame", 1024).groupBy("track_id", "lo").agg(
        (20 * F.log10(F.greatest(F.max("a"), F.lit(1e-6)))).alias("db"))
    p = materialise(o.select("track_id", "event_id", "lo").join(p, ["track_id", "lo"]).drop("lo"))
    med = quantiles.grouped(p, K, {"med": ("db", 0.5, "upper")})
    return p.join(med, "track_id").select(
        "track_id", "event_id", rnd("db").alias("peak_db"), rnd(F.greatest(F.lit(0.0), F.col("db") - F.col("med"))).alias("excess_db"))


@query("F20", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
q AS (SELECT track_id, frame, sum(l * l + r * r) AS p FROM ev GROUP BY 1, 2),
sc AS (SELECT track_id, frame - j AS f, p FROM q, (SELECT unnest(range(0, 4)) AS j) UNION ALL SELECT track_id, frame + 1 + j, -p FROM q, (SELECT unnest(range(0, 4)) AS j)),
ri AS (SELECT track_id, f, sum(p) AS rise FROM sc GROUP BY 1, 2),
o AS (SELECT track_id, event_id, frame AS detected, frames, greatest(4, frame - 90) AS lo, least(frames - 4, frame + 90) - 1 AS hi FROM ev JOIN ext USING (track_id) WHERE event_type = 'signup'),
b AS (SELECT o.track_id, event_id, detected, max(rise) AS best FROM o JOIN ri ON ri.track_id = o.track_id AND f BETWEEN lo AND hi WHERE rise > 0 GROUP BY 1, 2, 3),
a AS (SELECT o.track_id, o.event_id, min(f) AS f FROM o JOIN b ON o.track_id = b.track_id AND o.event_id = b.event_id JOIN ri ON ri.track_id = o.track_id AND f BETWEEN lo AND hi AND rise = best GROUP BY 1, 2)
SELECT o.track_id, o.event_id, detected, CASE WHEN f IS NULL THEN least(frames, detected) ELSE greatest(0, least(detected, f - 4)) END AS attack
FROM o LEFT JOIN a ON o.track_id = a.track_id AND o.event_id = a.event_id""")
def attack_refinement(spark, root):
    from soundgrid.operators.onsets import refine_attacks

    ev = event_samples(spark, root)
    onsets = ev.where("event_type = 'signup'").select("track_id", "event_id", F.col("frame").alias("detected"))
    power = ev.groupBy("track_id", "frame").agg(F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")).alias("p"))
    return refine_attacks(onsets, power, cells.extents(ev, K, "frame"), K, ["event_id"], 4, 90)


@query("I5", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
b AS (SELECT track_id, frame AS e FROM ev WHERE event_type = 'signup' UNION SELECT track_id, frames FROM ext),
s AS (SELECT track_id, coalesce(lag(e) OVER (PARTITION BY track_id ORDER BY e), 0) AS start, e AS "end" FROM b)
SELECT track_id, start, "end" FROM s WHERE "end" > start""")
def segment_layout(spark, root):
    ev = event_samples(spark, root)
    return intervals.segments(ev.where("event_type = 'signup'"), cells.extents(ev, K, "frame"), K, "frame", "frames")


@query("I5", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
b AS (SELECT track_id, frame AS e FROM ev WHERE event_type = 'signup' AND frame > 0 UNION SELECT track_id, frames FROM ext),
n AS (SELECT track_id, count(*) AS segs FROM b GROUP BY 1)
SELECT track_id, segs, CASE WHEN segs > 12 THEN 'too_many_segments' ELSE 'ok' END AS status FROM n""")
def segment_layout_status(spark, root):
    """Every track with its outcome under a limit of twelve segments: none leaves without a row."""
    ev = event_samples(spark, root)
    return segments.layout_status(ev.where("event_type = 'signup'"), cells.extents(ev, K, "frame"), K, "frame", "frames", limit=12)


@query("J11", "WITH" + EV_SQL + """,
o AS (SELECT DISTINCT track_id, frame AS s FROM ev WHERE event_type = 'signup'),
c AS (SELECT track_id, s, s + j AS f, CASE WHEN j < 0 THEN 0.5 - 0.5 * cos(pi() * (j + 18) / 18) WHEN j <= 108 THEN 1 ELSE 0.5 + 0.5 * cos(pi() * (j - 108) / 162) END AS w
      FROM o, (SELECT unnest(range(-18, 271)) AS j)),
m AS (SELECT track_id, f, max(w) AS w FROM c GROUP BY 1, 2)
SELECT ev.track_id, event_id, frame, R9(coalesce(w, 0)) AS weight, R9(pow(10, 6 * coalesce(w, 0) / 20)) AS gain FROM ev LEFT JOIN m ON m.track_id = ev.track_id AND f = frame""")
def punch_weights(spark, root):
    from soundgrid.operators.onsets import punch_weight

    ev = event_samples(spark, root)
    onsets = ev.where("event_type = 'signup'").select("track_id", F.col("frame").alias("s")).distinct()
    d = punch_weight(ev.select("track_id", "event_id", "frame"), onsets, K, "frame", "s", rise=18, hold=108, fall=162)
    return d.select("track_id", "event_id", "frame", rnd("weight", 9).alias("weight"), rnd(scalar.gain_from_db(6 * F.col("weight")), 9).alias("gain"))
