"""Segments, protection, comparable pairs, references and the structure report."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, loudness, segments, similarity, structure
from soundgrid.operators.blocks import previous_row
from soundgrid.plans import references
from soundgrid.queries.forms import CELL, HOP, NOV_SQL, RATE, SLOW_SQL, ev_features, ev_short_term
from soundgrid.queries.levels import K
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, event_samples, table

SEG_SQL = NOV_SQL.replace("nv AS MATERIALIZED", "nv0 AS") + """,
nv AS MATERIALIZED (SELECT track_id, idx, R9(novelty) AS novelty FROM nv0)""" + SLOW_SQL[len(EV_SQL):] + """,
be AS (SELECT track_id, frame // 450 * 450 AS e FROM ev WHERE event_type = 'signup' AND frame >= 450 UNION SELECT track_id, frames FROM nn),
sg AS MATERIALIZED (SELECT * FROM (SELECT track_id, coalesce(lag(e) OVER (PARTITION BY track_id ORDER BY e), 0) AS start, e AS "end", CAST(row_number() OVER (PARTITION BY track_id ORDER BY e) - 1 AS INTEGER) AS seg, count(*) OVER (PARTITION BY track_id) AS segs FROM be) WHERE segs <= 64),
ls0 AS (SELECT sg.track_id, seg, hop, s_lufs, ceil(start / 90) AS f, least(max(hop + 1) OVER (PARTITION BY st.track_id), ("end" - 2700) // 90 + 1) AS stop FROM sg JOIN (SELECT *, count(s_lufs) OVER w AS six, s_lufs - lag(s_lufs, 5) OVER w AS d5 FROM st WINDOW w AS (PARTITION BY track_id ORDER BY hop)) st ON st.track_id = sg.track_id WHERE FALSE),
hn AS (SELECT track_id, max(hop) + 1 AS hops FROM st GROUP BY 1),
s5 AS (SELECT track_id, hop, s_lufs, CASE WHEN count(s_lufs) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN s_lufs - lag(s_lufs, 5) OVER (PARTITION BY track_id ORDER BY hop) END AS d5 FROM st),
lr AS (SELECT sg.track_id, seg, CAST(ceil(start / 90) AS BIGINT) AS f, least(hops, ("end" - 2700) // 90 + 1) AS stop FROM sg JOIN hn USING (track_id) WHERE "end" >= 2700),
lq AS (SELECT *, greatest(1, (stop - f) // 4) AS q FROM lr WHERE f < stop),
lg AS (SELECT lq.track_id, seg, quantile_disc(s_lufs, 0.5) FILTER (s_lufs IS NOT NULL AND hop < f + q) AS h, quantile_disc(s_lufs, 0.5) FILTER (s_lufs IS NOT NULL AND hop >= stop - q) AS t,
   quantile_disc(hop, 0.5) FILTER (s_lufs IS NOT NULL AND hop < f + q) AS hh, quantile_disc(hop, 0.5) FILTER (s_lufs IS NOT NULL AND hop >= stop - q) AS th,
   count(d5) FILTER (hop >= f + 5) AS av, count(*) FILTER (hop >= f + 5 AND d5 > 0.05) AS up, count(*) FILTER (hop >= f + 5 AND d5 < -0.05) AS down
  FROM lq JOIN s5 ON s5.track_id = lq.track_id AND hop >= f AND hop < stop GROUP BY 1, 2),
ls AS (SELECT track_id, seg, (t - h) / ((th - hh) * 90 / 900) AS slope, t - h AS delta, CASE WHEN t = h OR up + down = 0 THEN 0 WHEN t > h THEN up / (up + down) ELSE down / (up + down) END AS consistency FROM lg WHERE h IS NOT NULL AND t IS NOT NULL AND th > hh AND av > 0),
cc AS (SELECT ac.track_id, ac.idx, ac.idx * 450 + (least(450, frames - ac.idx * 450) - 1) // 2 AS center, a FROM ac JOIN nn USING (track_id)),
aj AS (SELECT sg.track_id, seg, center, a, row_number() OVER (PARTITION BY sg.track_id, seg ORDER BY center) - 1 AS i, count(*) OVER (PARTITION BY sg.track_id, seg) AS n FROM sg JOIN cc ON cc.track_id = sg.track_id AND center >= start AND center < "end"),
ag AS (SELECT track_id, seg, n, avg(a) AS fg, quantile_disc(a, 0.9) - quantile_disc(a, 0.1) AS spread, quantile_disc(a, 0.5) FILTER (i < greatest(1, n // 4)) AS h, quantile_disc(a, 0.5) FILTER (i >= n - greatest(1, n // 4)) AS t,
   quantile_disc(center, 0.5) FILTER (i < greatest(1, n // 4)) AS hc, quantile_disc(center, 0.5) FILTER (i >= n - greatest(1, n // 4)) AS tc FROM aj GROUP BY 1, 2, 3),
ax AS (SELECT track_id, seg, fg, spread, CASE WHEN n >= 2 AND tc > hc THEN (t - h) / ((tc - hc) / 900) ELSE 0 END AS act FROM ag),
rr AS (SELECT sg.track_id, seg, s_lufs FROM sg JOIN st ON st.track_id = sg.track_id AND hop >= ceil(start / 90) AND hop <= floor(("end" - 2700) / 90) WHERE "end" - start >= 2700),
r1 AS (SELECT track_id, seg, count(*) AS possible, count(s_lufs) AS valid, -0.691 + 10 * log10(avg(pow(10, (s_lufs + 0.691) / 10)) FILTER (s_lufs > -70)) - 20 AS gate FROM rr GROUP BY 1, 2),
rg AS (SELECT track_id, seg, quantile_disc(s_lufs, 0.5) AS lufs FROM rr JOIN r1 USING (track_id, seg) WHERE valid >= 3 AND valid * 2 >= possible AND s_lufs > -70 AND s_lufs > gate GROUP BY 1, 2 HAVING count(*) >= 3),
de AS MATERIALIZED (SELECT sg.*, R9(lufs) AS lufs, R9(coalesce(slope, 0)) AS slope, R9(coalesce(delta, 0)) AS delta, R9(coalesce(consistency, 0)) AS consistency, R9(coalesce(fg, 0)) AS fg, R9(coalesce(spread, 0)) AS spread, R9(coalesce(act, 0)) AS act,
   R9(coalesce(a.novelty, 0)) AS ln, R9(coalesce(b.novelty, 0)) AS rn
  FROM sg LEFT JOIN rg USING (track_id, seg) LEFT JOIN ls USING (track_id, seg) LEFT JOIN ax USING (track_id, seg) LEFT JOIN nv a ON a.track_id = sg.track_id AND a.idx * 450 = start LEFT JOIN nv b ON b.track_id = sg.track_id AND b.idx * 450 = "end")"""
SEG_SQL = "\n".join(line for line in SEG_SQL.split("\n") if not line.startswith("ls0 AS"))


def descriptors(spark, root):
    """Segments cut at the sign-ups, with level, trend, activity and edge novelty."""
    ev = event_samples(spark, root)
    feats = materialise(ev_features(spark, root))
    nov = structure.novelty(feats, K).withColumn("novelty", rnd("novelty", 9))
    return describe(spark, root, ev.where(f"event_type = 'signup' AND frame >= {CELL}").select("track_id", F.expr(f"frame div {CELL} * {CELL}").alias("frame")).distinct(), feats, nov)


def describe(spark, root, cuts, feats, nov):
    ev = event_samples(spark, root)
    segs = materialise(segments.layout(cuts, cells.extents(ev, K, "frame"), K, "frame", "frames"))
    t = materialise(loudness.timeline(ev, K, HOP))
    lv = t.select("track_id", "hop", scalar.lufs(F.col("s_power")).alias("s_lufs"))
    reg = loudness.regional(segs, t, K, ["seg"], HOP).select("track_id", "seg", "lufs")
    stats = segments.loudness_stats(segs, lv, K, HOP, 2700, RATE)
    act = segments.activity_stats(segs, feats, K, CELL, RATE).drop("evaluable")
    edge = segments.edge_novelty(segs, nov, K, CELL)
    return materialise(segments.describe(segs, K, reg, stats, act, edge))


@query("C3 E17 I5", "WITH" + SEG_SQL + """ SELECT track_id, seg, start, "end", R6(lufs) AS lufs, R6(slope) AS slope, R6(delta) AS delta, R6(consistency) AS consistency, R6(fg) AS foreground, R6(spread) AS spread, R6(act) AS activity_slope, R6(ln(1 + ln)) AS left_novelty, R6(ln(1 + rn)) AS right_novelty FROM de""")
def segment_stats(spark, root):
    d = descriptors(spark, root)
    return d.select("track_id", "seg", "start", "end", *[rnd(c).alias(c) for c in ("lufs", "slope", "delta", "consistency", "foreground", "spread", "activity_slope")],
                    rnd(F.log1p("left_novelty")).alias("left_novelty"), rnd(F.log1p("right_novelty")).alias("right_novelty"))


PROT_SQL = SEG_SQL + """,
en AS (SELECT track_id, unnest([ln, rn]) AS v FROM de),
e1 AS (SELECT track_id, quantile_disc(v, 0.5) AS m FROM en GROUP BY 1), e2 AS (SELECT track_id, any_value(m) + 3 * quantile_disc(abs(v - m), 0.5) AS nl FROM en JOIN e1 USING (track_id) GROUP BY 1),
p1 AS (SELECT track_id, quantile_disc(spread, 0.5) AS m FROM de GROUP BY 1), p2 AS (SELECT track_id, any_value(m) + 3 * quantile_disc(abs(spread - m), 0.5) AS sl FROM de JOIN p1 USING (track_id) GROUP BY 1),
nb AS (SELECT de.*, nl, sl, lag(lufs) OVER w AS pl, lead(lufs) OVER w AS xl, lag(fg) OVER w AS pf, lead(fg) OVER w AS xf, R9(lufs - lag(lufs) OVER w) AS dl, R9(fg - lag(fg) OVER w) AS df,
   min(CASE WHEN lufs IS NOT NULL THEN seg END) OVER (PARTITION BY de.track_id) AS on0, max(CASE WHEN lufs IS NOT NULL THEN seg END) OVER (PARTITION BY de.track_id) AS on1 FROM de JOIN e2 USING (track_id) JOIN p2 USING (track_id) WINDOW w AS (PARTITION BY de.track_id ORDER BY seg)),
bu AS (SELECT *, count(df) OVER v AS na, count(dl) OVER v AS nl2, sum(dl) OVER v AS tl, sum(df) OVER v AS ta, count(*) FILTER (dl >= 0.25) OVER v AS lu, count(*) FILTER (dl <= -0.25) OVER v AS ld, count(*) FILTER (df >= 0.025) OVER v AS au, count(*) FILTER (df <= -0.025) OVER v AS ad
  FROM nb WINDOW v AS (PARTITION BY track_id ORDER BY seg ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)),
pt AS MATERIALIZED (SELECT *, CASE WHEN lufs IS NULL OR fg <= 0.5 THEN 1 ELSE 0 END + CASE WHEN seg = 0 OR on0 IS NULL OR seg <= on0 THEN 2 ELSE 0 END + CASE WHEN seg = segs - 1 OR on1 IS NULL OR seg >= on1 THEN 4 ELSE 0 END
  + CASE WHEN abs(delta) >= 3 AND abs(slope) >= 0.25 AND consistency >= 0.75 THEN 8 ELSE 0 END + CASE WHEN lufs <= pl - 3 AND lufs <= xl - 3 AND fg <= 0.75 * pf AND fg <= 0.75 * xf THEN 16 ELSE 0 END
  + CASE WHEN (ln > nl AND rn > nl AND spread > sl) OR "end" - start < 2700 THEN 32 ELSE 0 END + CASE WHEN (abs(slope) >= 0.1 AND abs(delta) >= 2) OR abs(act) >= 0.01 THEN 64 ELSE 0 END
  + CASE WHEN na >= 3 AND ((nl2 >= 3 AND ((R9(tl) >= 3 AND lu * 4 >= nl2 * 3) OR (R9(tl) <= -3 AND ld * 4 >= nl2 * 3))) OR ((R9(ta) >= 0.2 AND au * 4 >= na * 3) OR (R9(ta) <= -0.2 AND ad * 4 >= na * 3))) THEN 128 ELSE 0 END AS bits FROM bu)"""


def protected(spark, root):
    return segments.protect(descriptors(spark, root), K, RATE)


@query("C11 C12 C13", "WITH" + PROT_SQL + """ SELECT track_id, seg, CAST(bits AS INTEGER) AS bits, CASE WHEN bits <> 0 THEN 'protected' WHEN lag(bits) OVER w IS NULL OR lead(bits) OVER w IS NULL OR lag(bits) OVER w & 32 <> 0 OR lead(bits) OVER w & 32 <> 0 THEN 'body_ineligible'
  WHEN fg >= 0.8 AND lufs IS NOT NULL AND pl IS NOT NULL AND xl IS NOT NULL AND spread <= 0.15 AND abs(act) < 0.01 AND abs(slope) < 0.1 AND abs(delta) < 2 AND pf >= 0.5 AND xf >= 0.5 THEN 'none' ELSE 'body_ineligible' END AS body FROM pt WINDOW w AS (PARTITION BY track_id ORDER BY seg)""")
def segment_protection(spark, root):
    d = segments.eligible(segments.context(protected(spark, root), K), K)
    return d.select("track_id", "seg", "bits", "body")


PAIRS_SQL = SEG_SQL + """,
cx AS (SELECT track_id, seg, "end" - start AS len, lufs, fg, ln, rn, CASE WHEN fg > 1e-12 THEN coalesce(lag(fg) OVER w, fg) / fg ELSE 0 END AS rb, CASE WHEN fg > 1e-12 THEN coalesce(lead(fg) OVER w, fg) / fg ELSE 0 END AS ra,
   coalesce(least(1, greatest(-1, (lufs - lag(lufs) OVER w) / 12)), 0) AS en, coalesce(least(1, greatest(-1, (lead(lufs) OVER w - lufs) / 12)), 0) AS xt,
   CASE WHEN lag(lufs) OVER w IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN lufs IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN lead(lufs) OVER w IS NOT NULL THEN 4 ELSE 0 END AS mask FROM de WINDOW w AS (PARTITION BY track_id ORDER BY seg)),
pp AS MATERIALIZED (SELECT a.track_id, a.seg AS a, b.seg AS b, a.len / b.len AS ratio, a.fg AS fga, b.fg AS fgb, a.len AS la, b.len AS lb,
   CASE WHEN a.mask <> 7 OR b.mask <> 7 OR (CASE WHEN a.en * 12 < -1 THEN -1 WHEN a.en * 12 > 1 THEN 1 ELSE 0 END) <> (CASE WHEN b.en * 12 < -1 THEN -1 WHEN b.en * 12 > 1 THEN 1 ELSE 0 END)
     OR (CASE WHEN a.xt * 12 < -1 THEN -1 WHEN a.xt * 12 > 1 THEN 1 ELSE 0 END) <> (CASE WHEN b.xt * 12 < -1 THEN -1 WHEN b.xt * 12 > 1 THEN 1 ELSE 0 END)
     OR greatest(abs(a.rb - b.rb) / 0.25, abs(a.ra - b.ra) / 0.25, abs(a.en - b.en) / 0.25, abs(a.xt - b.xt) / 0.25, abs(a.ln - b.ln), abs(a.rn - b.rn)) > 1 THEN 'context_mismatch' ELSE 'none' END AS reason
  FROM cx a JOIN cx b ON a.track_id = b.track_id AND a.seg < b.seg AND a.len / b.len BETWEEN 0.75 AND 1.33)"""


def context_pairs(spark, root):
    d = segments.context(descriptors(spark, root), K)
    return segments.pairs(d, K, [*segments.CONTEXT, "foreground"]).withColumn("reason", segments.context_reason())


@query("C12 G8", "WITH" + PAIRS_SQL + " SELECT track_id, a, b, R6(ratio) AS ratio, reason FROM pp")
def segment_pairs(spark, root):
    return context_pairs(spark, root).select("track_id", "a", "b", rnd("ratio").alias("ratio"), "reason")


@query("H5", "WITH" + PAIRS_SQL + """,
sc AS (SELECT track_id, a, b, R9(least(ratio, 1 / ratio) * (1 - abs(fga - fgb))) AS score FROM pp),
bo AS (SELECT track_id, a AS x, b AS y, score FROM sc UNION ALL SELECT track_id, b, a, score FROM sc),
rk AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS nx FROM bo WINDOW w AS (PARTITION BY track_id, x ORDER BY score DESC, y)),
t1 AS (SELECT * FROM rk WHERE r = 1 AND abs(score - nx) > 1e-12)
SELECT p.track_id, p.x AS a, p.y AS b, p.score, R6(least(p.score - p.nx, p.score - q.nx)) AS margin FROM t1 p JOIN t1 q ON q.track_id = p.track_id AND q.x = p.y AND q.y = p.x WHERE p.x < p.y AND least(p.score - p.nx, p.score - q.nx) >= 0.02""")
def mutual_best(spark, root):
    p = context_pairs(spark, root)
    near = F.least(F.col("ratio"), 1 / F.col("ratio")) * (1 - F.abs(F.col("foreground_a") - F.col("foreground_b")))
    p = materialise(p.select("track_id", "a", "b", rnd(near, 9).alias("score")))
    return similarity.mutual_best(p, K, "score", 0.02).withColumn("margin", rnd("margin"))


@query("I4 J1 J2 J3 J4 J5 M5")
def structure_report(spark, root):
    """Whole chain per track: boundaries, segments, protection, similarity, groups, targets."""
    from soundgrid.plans.leveler import report

    return report(spark, root)


# --- similarity on the embedding table ---------------------------------------------------

EM_SQL = """WITH em AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ep AS (SELECT vec_id, e AS a, lead(e) OVER (ORDER BY vec_id) AS b FROM em QUALIFY lead(vec_id) OVER (ORDER BY vec_id) IS NOT NULL)"""


def vector_pairs(spark, root):
    """Each vector with the one of the next id, whatever the gap between them."""
    e = table(spark, root, "embeddings").select(F.lit(0).alias("_all"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    d = previous_row(e, ["_all"], "vec_id", {"_id": "vec_id", "a": "b"}).where("_id IS NOT NULL")
    return d.select(F.col("_id").alias("vec_id"), "a", "b")


@query("B24", EM_SQL + """,
i36 AS (SELECT unnest(range(1, 37)) AS i), i8 AS (SELECT unnest(range(1, 9)) AS i),
t AS (SELECT vec_id, sum(abs(a[i])) AS sa, sum(abs(b[i])) AS sb, sum(abs(a[i + 28])) AS la, sum(abs(b[i + 28])) AS lb, any_value(a) AS a, any_value(b) AS b FROM ep CROSS JOIN i36 GROUP BY 1),
d AS (SELECT vec_id, any_value(a) AS a, any_value(b) AS b, 0.5 * sum(abs(abs(a[i]) / sa - abs(b[i]) / sb)) AS short, 0.5 * sum(abs(abs(a[i + 28]) / la - abs(b[i + 28]) / lb)) AS long FROM t CROSS JOIN i36 GROUP BY 1),
w AS (SELECT vec_id, any_value(a) AS a, any_value(b) AS b, any_value(short) AS short, any_value(long) AS long, sum(greatest(pow(10, a[36 + i]), pow(10, b[36 + i]))) AS ws,
   sum(greatest(pow(10, a[36 + i]), pow(10, b[36 + i])) * (pow(10 * (a[36 + i] - b[36 + i]), 2) + pow(10 * (a[44 + i] - b[44 + i]), 2))) AS sq FROM d CROSS JOIN i8 GROUP BY 1)
SELECT vec_id, R6(CASE WHEN a[64] > 0 AND b[64] > 0 THEN greatest(CASE WHEN a[1] > 0 AND b[1] > 0 THEN short WHEN a[1] > 0 OR b[1] > 0 THEN 1 ELSE 0 END, long) ELSE 1 END) AS tone, R6(CASE WHEN a[64] > 0 AND b[64] > 0 THEN 1 - exp(-(0.5 * sq / ws) / (2 * 3.01 * 3.01)) ELSE 1 END) AS timbre FROM w""")
def cell_distance(spark, root):
    p = vector_pairs(spark, root)

    def dist(c, start):
        v = F.transform(F.slice(c, start, 36), F.abs)
        return F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y))

    ten = lambda c, start: F.transform(F.slice(c, start, 8), lambda x: x * 10)
    short = similarity.gated_tone(F.col("a")[0] > 0, F.col("b")[0] > 0, similarity.tone_distance(dist("a", 1), dist("b", 1)))
    long = similarity.tone_distance(dist("a", 29), dist("b", 29))
    timbre = similarity.timbre_distance(ten("a", 37), ten("b", 37), ten("a", 45), ten("b", 45))
    tone, timbre = similarity.cell_distance(short, long, timbre, (F.col("a")[63] > 0) & (F.col("b")[63] > 0))
    return p.select("vec_id", rnd(tone).alias("tone"), rnd(timbre).alias("timbre"))


@query("H6", EM_SQL + """,
bn AS (SELECT vec_id, bin, r, k, abs(a[bin * 12 + k + 1]) AS x, abs(b[bin * 12 + (k + r) % 12 + 1]) AS y FROM ep CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS bin) CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS r) CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS k)),
cs AS (SELECT vec_id, bin, r, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM bn GROUP BY 1, 2, 3),
mn AS (SELECT vec_id, r, avg(least(1, greatest(0, c))) AS m FROM cs GROUP BY 1, 2),
bs AS (SELECT vec_id, r, m FROM mn QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(m, 12) DESC, r) = 1),
tp AS (SELECT vec_id, bin, max(c) AS top FROM cs GROUP BY 1, 2)
SELECT bs.vec_id, bs.r AS rotation, R6(bs.m) AS mean, count(*) AS bins, CAST(count(*) FILTER (c >= top - 1e-12) AS BIGINT) AS support, bs.r = 0 OR count(*) FILTER (c >= top - 1e-12) * 5 >= count(*) * 4 AS clear
FROM bs JOIN cs ON cs.vec_id = bs.vec_id AND cs.r = bs.r JOIN tp ON tp.vec_id = cs.vec_id AND tp.bin = cs.bin GROUP BY 1, 2, bs.m""")
def chroma_rotation(spark, root):
    p = vector_pairs(spark, root).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cut = lambda c: F.transform(F.slice(c, F.col("bin") * 12 + 1, 12), F.abs)
    d = similarity.best_rotation(p.select("vec_id", "bin", cut("a").alias("a"), cut("b").alias("b")), ["vec_id"], "a", "b")
    return d.select("vec_id", "rotation", rnd("mean").alias("mean"), "bins", "support", ((F.col("rotation") == 0) | (F.col("support") * 5 >= F.col("bins") * 4)).alias("clear"))


@query("J15", EM_SQL + """,
lg AS (SELECT vec_id, lag, 64 - abs(lag) AS n, sum(a[i] * a[i]) / (64 - abs(lag)) AS sx, sum(b[i + lag] * b[i + lag]) / (64 - abs(lag)) AS sy, sum(a[i] * b[i + lag]) / (64 - abs(lag)) AS sxy
  FROM ep CROSS JOIN (SELECT CAST(unnest(range(-4, 5)) AS INTEGER) AS lag) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) WHERE i + lag BETWEEN 1 AND 64 GROUP BY 1, 2),
rs AS (SELECT vec_id, lag, sxy / sy AS alpha, sqrt(greatest(0, sx - sxy * sxy / sy)) / greatest(sqrt(sx), sxy / sy * sqrt(sy), 1e-12) AS residual FROM lg WHERE sqrt(sx) > 1e-12 AND sqrt(sy) > 1e-12 AND sxy / sy > 0)
SELECT vec_id, lag, R6(alpha) AS alpha, R6(residual) AS residual FROM rs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(residual, 12), abs(lag), lag) = 1""")
def sketch_match(spark, root):
    d = similarity.sketch_match(vector_pairs(spark, root), ["vec_id"], "a", "b", 64, min_overlap=0.9)
    return d.select("vec_id", "lag", rnd("alpha").alias("alpha"), rnd("residual").alias("residual"))


@query("D5 G11", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
s AS (SELECT DISTINCT track_id, frames, frame // 90 AS cell FROM ev JOIN ext USING (track_id)),
c AS (SELECT *, cell * 90 + (least(frames, (cell + 1) * 90) - cell * 90 - 1) // 2 AS center, (frames - 1) // 450 AS top FROM s),
l AS (SELECT c.*, least(top, center // 450) + o AS long FROM c CROSS JOIN (VALUES (-1), (0), (1)) v(o)),
d AS (SELECT track_id, cell, long, abs(long * 450 + (least(frames, (long + 1) * 450) - long * 450 - 1) // 2 - center) AS gap FROM l WHERE long BETWEEN 0 AND top)
SELECT track_id, cell, long AS nearest, gap FROM d QUALIFY row_number() OVER (PARTITION BY track_id, cell ORDER BY gap, long) = 1""")
def nearest_cell(spark, root):
    """For every sounding 40 Hz cell the 8 Hz cell with the nearest centre (rate 3600)."""
    from soundgrid.operators.joins import nearest_long_cell

    ev = event_samples(spark, root)
    short = ev.select("track_id", F.expr("frame div 90").alias("cell")).distinct().join(cells.extents(ev, K, "frame"), "track_id")
    return nearest_long_cell(short, K, 90, 450).select("track_id", "cell", "nearest", "gap")


WEIGHT_SQL = """WITH m AS (SELECT l_orderkey AS grp, l_linenumber AS member, l_quantity AS level, l_discount * 10 AS quality, 0.5 + 0.5 * (l_discount * 10) AS u, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_discount) OVER (PARTITION BY l_orderkey) AS conf
   FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)),
a AS (SELECT *, sum(u) OVER (PARTITION BY grp) AS s0 FROM m WHERE n >= 3),
b AS (SELECT *, min(CASE WHEN u / s0 > 0.40 THEN member END) OVER (PARTITION BY grp) AS c1 FROM a),
c AS (SELECT *, CASE WHEN c1 IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 0.4::DOUBLE END AS left1, sum(CASE WHEN c1 IS NULL OR member <> c1 THEN u ELSE 0 END) OVER (PARTITION BY grp) AS s1 FROM b),
d AS (SELECT *, min(CASE WHEN c1 IS NOT NULL AND member <> c1 AND left1 * u / s1 > 0.40 THEN member END) OVER (PARTITION BY grp) AS c2 FROM c),
e AS (SELECT *, left1 - CASE WHEN c2 IS NULL THEN 0 ELSE 0.4::DOUBLE END AS left2, sum(CASE WHEN (c1 IS NULL OR member <> c1) AND (c2 IS NULL OR member <> c2) THEN u ELSE 0 END) OVER (PARTITION BY grp) AS s2 FROM d),
w AS (SELECT grp, member, level, conf, CASE WHEN member = c1 OR member = c2 THEN 0.4 ELSE left2 * u / s2 END AS weight FROM e)"""


def weighted_members(spark, root):
    """Lines of an order as the members of a group: at most seven."""
    li = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("member")).agg(
        F.max("l_quantity").alias("level"), F.max("l_discount").alias("d"))
    n = li.groupBy("grp").agg(F.count("*").alias("n"), F.max("d").alias("conf")).where("n >= 3")
    return references.water_fill(li.join(n, "grp").withColumn("quality", F.col("d") * 10), ["grp"], "member", "quality")


@query("J3", WEIGHT_SQL + " SELECT grp, member, R9(weight) AS weight FROM w")
def waterfill_weights(spark, root):
    return weighted_members(spark, root).select("grp", "member", rnd("weight", 9).alias("weight"))


@query("J4", WEIGHT_SQL + """,
r AS (SELECT *, sum(weight) OVER (PARTITION BY grp ORDER BY level, member ROWS UNBOUNDED PRECEDING) AS cum FROM w),
f AS (SELECT grp, coalesce(min(level) FILTER (round(cum, 12) >= 0.5), max(level)) AS ref FROM r GROUP BY 1)
SELECT grp, member, ref AS reference, R6(sign(ref - level) * greatest(0, abs(ref - level) - 1) + 0.0) AS raw_db, R6(sign(ref - level) * greatest(0, abs(ref - level) - 1) * conf + 0.0) AS weighted_db FROM w JOIN f USING (grp)""")
def weighted_median(spark, root):
    m = weighted_members(spark, root)
    ref = references.weighted_lower_median(m, ["grp"], "member", "level", "weight", "reference")
    d = m.join(ref, "grp")
    raw, weighted = references.target(F.col("level"), F.col("reference"), F.col("conf"))
    return d.select("grp", "member", "reference", rnd(raw).alias("raw_db"), rnd(weighted).alias("weighted_db"))
