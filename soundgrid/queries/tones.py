"""Spectra, onsets, tempo and frequency maps."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, onsets, spectra
from soundgrid.queries.levels import K
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, event_samples, table

N, WHOP = 64, 32
FS = 8000.0  # nominal rate of the cell signal: bin k lies at k * 125 Hz

DFT_SQL = EV_SQL + f""",
ext AS (SELECT track_id, (max(frame) // 360) + 1 AS ncells FROM ev GROUP BY 1),
sg AS (SELECT track_id, frame // 360 AS c, sum(l) AS l, sum(r) AS r FROM ev GROUP BY 1, 2),
wx AS (SELECT sg.track_id, win, c - win * 32 AS i, l * (0.5 - 0.5 * cos(2 * pi() * (c - win * 32) / 64)) AS l, r * (0.5 - 0.5 * cos(2 * pi() * (c - win * 32) / 64)) AS r
  FROM sg JOIN ext USING (track_id) JOIN (SELECT unnest(range(0, 1000)) AS win) ON c >= win * 32 AND c < win * 32 + 64 AND win * 32 + 64 <= ncells),
fx AS (SELECT track_id, win, bin, sum(l * cos(2 * pi() * ((bin * i) % 64) / 64)) AS lc, sum(l * sin(2 * pi() * ((bin * i) % 64) / 64)) AS ls,
   sum(r * cos(2 * pi() * ((bin * i) % 64) / 64)) AS rc, sum(r * sin(2 * pi() * ((bin * i) % 64) / 64)) AS rs
  FROM wx CROSS JOIN (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS bin) GROUP BY 1, 2, 3),
sp AS (SELECT track_id, win, bin, (lc * lc + ls * ls) * k AS p_ll, (rc * rc + rs * rs) * k AS p_rr, (lc * rc + ls * rs) * k AS p_lr, ((lc * lc + ls * ls) + (rc * rc + rs * rs)) / 2 * k AS power
  FROM (SELECT *, CASE WHEN bin IN (0, 32) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / (64 * 24) AS k FROM fx))"""


def ev_spectra(spark, root):
    """Short-window spectra of the 100 ms cell sums."""
    ev = event_samples(spark, root)
    sig = cells.cells(ev, K, "frame", 360, {"l": F.sum("l"), "r": F.sum("r")}, "c")
    n = ev.groupBy("track_id").agg((F.expr("max(frame) div 360") + 1).alias("ncells"))
    d = spectra.dft_powers(sig, n, K, "c", "ncells", N, WHOP, "l", "r")
    return d.withColumn("power", (F.col("p_ll") + F.col("p_rr")) / 2)


EDGES = [0.0, 120.0, 300.0, 1000.0, 2000.0, 4000.0]


@query("B16 E9", "WITH" + DFT_SQL + """
SELECT track_id, win, CASE WHEN bin * 125 >= 2000 THEN 4 WHEN bin * 125 >= 1000 THEN 3 WHEN bin * 125 >= 300 THEN 2 WHEN bin * 125 >= 120 THEN 1 ELSE 0 END AS band,
  R6(sum(p_ll)) AS p_ll, R6(sum(p_rr)) AS p_rr, R6(sum(p_lr)) AS p_lr FROM sp GROUP BY 1, 2, 3""")
def dft_bands(spark, root):
    d = ev_spectra(spark, root).withColumn("band", spectra.band_of(F.col("bin") * (FS / N), EDGES))
    return d.groupBy("track_id", "win", "band").agg(*[rnd(F.sum(c)).alias(c) for c in ("p_ll", "p_rr", "p_lr")])


GRID_SQL = DFT_SQL + """,
pw AS (SELECT track_id, bin, avg(power) AS power FROM sp GROUP BY 1, 2),
g0 AS (SELECT i AS point, 100 * pow(10, log10(50.0::DOUBLE) * i / 63) AS hz FROM (SELECT unnest(range(64)) AS i)),
gr AS (SELECT point, hz, lo, greatest(lo, least(32, CAST(ceil(hz * pow(2, 1 / 24.0::DOUBLE) / 125) AS BIGINT))) AS hi, hz <= 4000 AS ok
  FROM (SELECT *, greatest(1, least(32, CAST(floor(hz * pow(2, -1 / 24.0::DOUBLE) / 125) AS BIGINT))) AS lo FROM g0)),
rw AS (SELECT t.track_id, point, hz, ok, CASE WHEN ok THEN 10 * log10(greatest(coalesce(sum(power), 0) / (hi - lo + 1), 1e-12)) ELSE -120 END AS raw_db
  FROM (SELECT DISTINCT track_id FROM pw) t CROSS JOIN gr LEFT JOIN pw ON pw.track_id = t.track_id AND bin BETWEEN lo AND hi GROUP BY t.track_id, point, hz, ok, lo, hi),
sm AS (SELECT track_id, point, hz, raw_db, CASE WHEN ok THEN avg(raw_db) FILTER (ok) OVER (PARTITION BY track_id ORDER BY point ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) ELSE -120 END AS db FROM rw)"""


def ev_grid(spark, root):
    pooled = ev_spectra(spark, root).groupBy("track_id", "bin").agg(F.avg("power").alias("power"))
    return spectra.project(pooled, K, spectra.Grid(FS, N, 100.0, 5000.0, 64))


@query("B12 B14 E8", "WITH" + GRID_SQL + """
SELECT track_id, point, R6(hz) AS hz, R6(raw_db) AS raw_db, R6(db) AS db, R6(CASE WHEN db <= -120 THEN -120 ELSE greatest(-120, db + 4.5 * log2(hz / 1000)) END) AS tilted_db FROM sm""")
def spectrum_grid(spark, root):
    tilted = F.when(F.col("db") <= -120, -120.0).otherwise(F.greatest(F.lit(-120.0), F.col("db") + scalar.display_tilt_db(F.col("hz"))))
    return ev_grid(spark, root).select("track_id", "point", rnd("hz").alias("hz"), rnd("raw_db").alias("raw_db"), rnd("db").alias("db"), rnd(tilted).alias("tilted_db"))


@query("B13", "WITH" + GRID_SQL + """,
q AS (SELECT track_id, event_id, 100 + abs(l) * 700 AS hz FROM ev WHERE event_type = 'purchase'),
x AS (SELECT *, log10(greatest(hz, 100) / 100) / log10(50.0::DOUBLE) * 63 AS ix FROM q)
SELECT x.track_id, event_id, R6(x.hz) AS hz, R6(CASE WHEN x.hz > 4000 THEN -120 WHEN b.db IS NULL THEN a.db ELSE a.db * (1 - (ix - floor(ix))) + b.db * (ix - floor(ix)) END) AS db
FROM x JOIN sm a ON a.track_id = x.track_id AND a.point = least(63, floor(ix)) LEFT JOIN sm b ON b.track_id = x.track_id AND b.point = floor(ix) + 1""")
def level_at_frequency(spark, root):
    q = event_samples(spark, root).where("event_type = 'purchase'").select("track_id", "event_id", (100 + F.abs("l") * 700).alias("hz"))
    q = q.withColumn("ix", scalar.grid_index(F.col("hz"), 100.0, 5000.0, 64)).withColumn("point", F.least(F.lit(63).cast("bigint"), F.floor("ix")))
    g = ev_grid(spark, root).select("track_id", "point", "db")
    nxt = g.select("track_id", (F.col("point") - 1).alias("point"), F.col("db").alias("db1"))
    part = F.col("ix") - F.floor("ix")
    level = F.when(F.col("hz") > FS / 2, -120.0).when(F.col("db1").isNull(), F.col("db")).otherwise(F.col("db") * (1 - part) + F.col("db1") * part)
    return q.join(g, ["track_id", "point"]).join(nxt, ["track_id", "point"], "left").select(
        "track_id", "event_id", rnd("hz").alias("hz"), rnd(level).alias("db"))


@query("B15 E14", "WITH" + DFT_SQL + """,
s AS (SELECT track_id, win, power, 69 + 12 * log2(bin * 125.0::DOUBLE / 440) AS m FROM sp WHERE bin * 125 >= 55 AND bin * 125 <= 3800),
c AS (SELECT track_id, win, ((CAST(floor(m) AS BIGINT) % 12) + 12) % 12 AS pc, power * (1 - (m - floor(m))) AS v FROM s
      UNION ALL SELECT track_id, win, ((CAST(floor(m) AS BIGINT) + 1) % 12 + 12) % 12, power * (m - floor(m)) FROM s),
a AS (SELECT t.track_id, t.win, k AS pc, coalesce(sum(v), 0) AS v FROM (SELECT DISTINCT track_id, win FROM s) t CROSS JOIN (SELECT unnest(range(12)) AS k) LEFT JOIN c ON c.track_id = t.track_id AND c.win = t.win AND c.pc = k GROUP BY 1, 2, 3),
f AS (SELECT *, nth_value(v, 2) OVER (PARTITION BY track_id, win ORDER BY v, pc ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fl FROM a),
g AS (SELECT track_id, win, pc, greatest(0, v - fl) AS v FROM f)
SELECT track_id, win, CAST(pc AS INTEGER) AS pitch_class, R6(CASE WHEN sqrt(sum(v * v) OVER w) > 1e-12 THEN v / sqrt(sum(v * v) OVER w) ELSE v END) AS chroma FROM g WINDOW w AS (PARTITION BY track_id, win)""")
def chroma(spark, root):
    d = spectra.chroma(ev_spectra(spark, root), ["track_id", "win"], F.col("bin") * (FS / N), "power", 55.0, min(5000.0, 0.95 * FS / 2))
    return d.select("track_id", "win", F.posexplode("chroma").alias("pitch_class", "c")).select("track_id", "win", "pitch_class", rnd("c").alias("chroma"))


@query("E14", "WITH" + DFT_SQL + """,
s AS (SELECT track_id, win, power, least(7, greatest(0, CAST(floor(ln(bin * 125.0::DOUBLE / 60) / (ln(3800 / 60.0::DOUBLE) / 8)) AS BIGINT))) AS b FROM sp WHERE bin * 125 >= 60 AND bin * 125 <= 3800),
a AS (SELECT t.track_id, t.win, k AS b, ln(1 + coalesce(sum(power), 0)) AS v FROM (SELECT DISTINCT track_id, win FROM s) t CROSS JOIN (SELECT unnest(range(8)) AS k) LEFT JOIN s ON s.track_id = t.track_id AND s.win = t.win AND s.b = k GROUP BY 1, 2, 3),
g AS (SELECT track_id, win, b, v - avg(v) OVER (PARTITION BY track_id, win) AS v FROM a)
SELECT track_id, win, CAST(b AS INTEGER) AS band, R6(CASE WHEN sqrt(sum(v * v) OVER w) > 1e-12 THEN v / sqrt(sum(v * v) OVER w) ELSE v END) AS shape FROM g WINDOW w AS (PARTITION BY track_id, win)""")
def spectral_shape(spark, root):
    d = spectra.spectral_shape(ev_spectra(spark, root), ["track_id", "win"], F.col("bin") * (FS / N), "power", min(16000.0, 0.95 * FS / 2))
    return d.select("track_id", "win", F.posexplode("shape").alias("band", "s")).select("track_id", "win", "band", rnd("s").alias("shape"))


@query("E26", "WITH" + DFT_SQL + """,
pk AS (SELECT track_id, win, max(power) AS peak FROM sp WHERE bin * 125 BETWEEN 200 AND 3800 GROUP BY 1, 2),
n0 AS (SELECT a.track_id, a.win, a.bin, quantile_disc(b.power, 0.5) AS noise FROM sp a JOIN sp b ON a.track_id = b.track_id AND a.win = b.win AND b.bin >= 1 AND abs(a.bin - b.bin) BETWEEN 2 AND 4 GROUP BY 1, 2, 3),
x AS (SELECT track_id, win, bin, power, lag(power) OVER w AS pv, lead(power) OVER w AS nx FROM sp WINDOW w AS (PARTITION BY track_id, win ORDER BY bin)),
y AS (SELECT x.*, peak, ln(greatest(pv, peak * 1e-12)) / 2 AS a, ln(greatest(power, peak * 1e-12)) / 2 AS b, ln(greatest(nx, peak * 1e-12)) / 2 AS c FROM x JOIN pk USING (track_id, win) JOIN n0 USING (track_id, win, bin)
   WHERE bin * 125 BETWEEN 200 AND 3800 AND power > pv AND power >= nx AND power >= peak * 1e-4 AND power >= 4 * greatest(noise, peak * 1e-12)),
z AS (SELECT track_id, win, least(1, greatest(0, 1 + 10 * log10(power / peak) / 40)) AS sal, (bin + CASE WHEN a - 2 * b + c = 0 THEN 0 ELSE least(0.5, greatest(-0.5, 0.5 * (a - c) / (a - 2 * b + c))) END) * 125 AS hz FROM y),
p AS (SELECT track_id, win, sal, (69 + 12 * log2(hz / 440)) - 12 * floor((69 + 12 * log2(hz / 440)) / 12) AS pitch FROM z WHERE hz BETWEEN 200 AND 3800),
v AS (SELECT track_id, win, k AS pitch_bin, max(sal * (1 + cos(pi() * least(abs(pitch - k / 3.0::DOUBLE), 12 - abs(pitch - k / 3.0::DOUBLE)))) / 2) AS v
  FROM p CROSS JOIN (SELECT unnest(range(36)) AS k) WHERE least(abs(pitch - k / 3.0::DOUBLE), 12 - abs(pitch - k / 3.0::DOUBLE)) <= 1 GROUP BY 1, 2, 3)
SELECT track_id, win, pitch_bin, R6(v / sum(v) OVER (PARTITION BY track_id, win)) AS salience FROM v QUALIFY sum(v) OVER (PARTITION BY track_id, win) > 0""")
def pitch_salience(spark, root):
    d = spectra.pitch_salience(ev_spectra(spark, root).select("track_id", "win", "bin", "power"), ["track_id", "win"], FS, N, N, 200.0, 3800.0, prominence=4.0)
    return d.withColumn("salience", rnd("salience"))


@query("E27", "WITH" + DFT_SQL + """,
e AS (SELECT k, 60 * pow(3800 / 60.0::DOUBLE, k / 4.0::DOUBLE) AS hz FROM (SELECT unnest(range(4)) AS k)),
s AS (SELECT track_id, win, bin, power, (SELECT max(k) FROM e WHERE e.hz <= bin * 125) AS band FROM sp WHERE bin >= 1 AND bin * 125 BETWEEN 60 AND 3800),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, win, band ORDER BY power, bin) AS up, row_number() OVER (PARTITION BY track_id, win, band ORDER BY power DESC, bin DESC) AS down,
   count(*) OVER (PARTITION BY track_id, win, band) AS n, max(power) OVER (PARTITION BY track_id, win) AS peak FROM s),
g AS (SELECT track_id, win, band, sum(power) AS e, max(peak) AS peak, avg(power) FILTER (up <= greatest(1, ceil(0.1 * n))) AS valley, avg(power) FILTER (down <= greatest(1, ceil(0.1 * n))) AS top FROM r WHERE peak > 0 GROUP BY 1, 2, 3),
h AS (SELECT *, sum(e) OVER (PARTITION BY track_id, win) AS total, count(*) OVER (PARTITION BY track_id, win) AS bands FROM g)
SELECT track_id, win, CAST(band AS INTEGER) AS band, R6(10 * log10(greatest(e / total, 1e-4))) AS level_db, R6(least(40, greatest(0, 10 * log10(greatest(top, peak * 1e-4) / greatest(valley, peak * 1e-4))))) AS contrast_db FROM h WHERE bands = 4""")
def timbre(spark, root):
    # Four bands: the short spectra have no bins in the lowest of eight.
    d = spectra.timbre(ev_spectra(spark, root).select("track_id", "win", "bin", "power"), ["track_id", "win"], FS, N, bands=4)
    return d.withColumns({"level_db": rnd("level_db"), "contrast_db": rnd("contrast_db")})


# --- onsets and tempo -------------------------------------------------------

ONSET_SQL = EV_SQL + """,
lt AS (SELECT track_id, max(frame) // 18 + 1 AS cells FROM ev GROUP BY 1),
nd AS (SELECT track_id, unnest(range(0, cells)) AS cell FROM lt),
mg AS (SELECT track_id, frame // 18 AS cell, sqrt(sum(l * l + r * r)) AS m FROM ev GROUP BY 1, 2),
fl AS (SELECT nd.track_id, nd.cell, greatest(0, coalesce(m, 0) - lag(coalesce(m, 0), 1, 0::DOUBLE) OVER (PARTITION BY nd.track_id ORDER BY nd.cell)) AS f FROM nd LEFT JOIN mg ON mg.track_id = nd.track_id AND mg.cell = nd.cell),
nv AS (SELECT track_id, cell, f / max(f) OVER (PARTITION BY track_id) AS v FROM fl),
cx AS (SELECT track_id, cell, v, lag(v) OVER w AS pv, lead(v) OVER w AS nx, avg(v) OVER (PARTITION BY track_id ORDER BY cell ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mean FROM nv WINDOW w AS (PARTITION BY track_id ORDER BY cell)),
cand AS (SELECT track_id, cell, v FROM cx WHERE pv IS NOT NULL AND nx IS NOT NULL AND v >= pv AND v >= nx AND v >= mean + 0.06),
pick AS (SELECT track_id, min(cell) AS cell FROM cand GROUP BY 1
   UNION ALL SELECT p.track_id, (SELECT min(c.cell) FROM cand c WHERE c.track_id = p.track_id AND c.cell >= p.cell + 5) AS cell FROM pick p WHERE p.cell IS NOT NULL),
ons AS (SELECT c.track_id, c.cell, c.v AS strength FROM pick p JOIN cand c ON c.track_id = p.track_id AND c.cell = p.cell)"""

CELL, CELL_RATE = 18, 100.0


def ev_onsets(spark, root):
    """Onsets of the event signal at 10 ms cells (1800 frames a second)."""
    ev = event_samples(spark, root)
    nov = onsets.energy_flux(ev, K, CELL)
    n = ev.groupBy("track_id").agg((F.expr(f"max(frame) div {CELL}") + 1).alias("cells"))
    return onsets.pick(nov, n, K, radius=10, gap=5), nov


@query("F7 F13 F14 M6 N4", "WITH RECURSIVE" + ONSET_SQL + """,
du AS (SELECT o.track_id, o.cell, coalesce(min(n.cell) FILTER (n.v <= 0.35 * o.strength), max(n.cell)) - o.cell AS len FROM ons o LEFT JOIN nv n ON n.track_id = o.track_id AND n.cell > o.cell AND n.cell <= o.cell + 12 GROUP BY 1, 2)
SELECT o.track_id, o.cell / 100.0::DOUBLE AS t, R6(strength) AS strength, greatest(0.02::DOUBLE, least(0.12::DOUBLE, coalesce(len, 0) / 100.0::DOUBLE)) AS duration FROM ons o JOIN du ON o.track_id = du.track_id AND o.cell = du.cell""")
def onset_table(spark, root):
    on, nov = ev_onsets(spark, root)
    d = onsets.durations(on, nov, K, 12)
    return d.select("track_id", (F.col("cell") / CELL_RATE).alias("t"), rnd("strength").alias("strength"),
                    scalar.clamp(F.col("length") / CELL_RATE, 0.02, 0.12).alias("duration"))


PAIR_SQL = ONSET_SQL + """,
pr AS (SELECT a.track_id, CAST(floor((b.cell / 100.0::DOUBLE - a.cell / 100.0::DOUBLE) / 0.005::DOUBLE + 0.5) AS BIGINT) AS bin, greatest(0.05, a.strength) * greatest(0.05, b.strength) AS s
  FROM ons a JOIN ons b ON a.track_id = b.track_id AND b.cell > a.cell AND b.cell / 100.0::DOUBLE - a.cell / 100.0::DOUBLE <= 2.05::DOUBLE),
hs AS (SELECT track_id, bin, sum(s) AS salience, count(*) AS pairs FROM pr GROUP BY 1, 2)"""


def ev_onset_times(spark, root):
    on, _ = ev_onsets(spark, root)
    return materialise(on.select("track_id", (F.col("cell") / CELL_RATE).alias("t"), "strength"))


@query("G9", "WITH RECURSIVE" + PAIR_SQL + " SELECT track_id, bin, R6(salience) AS salience, pairs FROM hs")
def onset_pairs(spark, root):
    return onsets.lag_histogram(ev_onset_times(spark, root), K).withColumn("salience", rnd("salience"))


SCORE_SQL = PAIR_SQL + """,
tg AS (SELECT i AS cand, 60 + i * 0.25::DOUBLE AS bpm FROM (SELECT unnest(range(561)) AS i)),
mu(k, wt) AS (VALUES (1.0::DOUBLE, 1.0::DOUBLE), (2.0, 0.5), (0.5, 0.1), (1.5, 0.1)),
kn AS (SELECT cand, bpm, bin, sum(wt * greatest(0, 1 - abs(bin * 0.005::DOUBLE - k * 60 / bpm) / 0.025::DOUBLE)) AS w
  FROM tg CROSS JOIN mu CROSS JOIN (SELECT unnest(range(1, 412)) AS bin) WHERE k * 60 / bpm <= 2.05 GROUP BY 1, 2, 3),
sc AS (SELECT track_id, cand, bpm, sum(salience * w) AS support, sum(salience * w) * exp(-0.5 * pow(ln(bpm / 120) / ln(2), 2)) AS score FROM hs JOIN kn USING (bin) WHERE w > 0 GROUP BY 1, 2, 3)"""


@query("G10", "WITH RECURSIVE" + SCORE_SQL + " SELECT track_id, cand, bpm, R6(support) AS support, R6(score) AS score FROM sc WHERE support > 0")
def tempo_grid(spark, root):
    d = onsets.tempo_scores(onsets.lag_histogram(ev_onset_times(spark, root), K), K).where("support > 0")
    return d.withColumns({"support": rnd("support"), "score": rnd("score")})


def tempo_sql(src: str, name: str) -> str:
    """Estimate of one range of onsets as a chain of CTEs (the SQL twin)."""
    n = name
    return f""",
{n}_pr AS (SELECT a.track_id, CAST(floor((b.cell / 100.0::DOUBLE - a.cell / 100.0::DOUBLE) / 0.005::DOUBLE + 0.5) AS BIGINT) AS bin, greatest(0.05, a.strength) * greatest(0.05, b.strength) AS s
  FROM {src} a JOIN {src} b ON a.track_id = b.track_id AND b.cell > a.cell AND b.cell / 100.0::DOUBLE - a.cell / 100.0::DOUBLE <= 2.05::DOUBLE),
{n}_hs AS (SELECT track_id, bin, sum(s) AS salience, count(*) AS pairs FROM {n}_pr GROUP BY 1, 2),
{n}_sc AS (SELECT track_id, cand, bpm, sum(salience * w) * exp(-0.5 * pow(ln(bpm / 120) / ln(2), 2)) AS score FROM {n}_hs JOIN kn USING (bin) WHERE w > 0 GROUP BY 1, 2, 3),
{n}_al AS (SELECT t.track_id, tg.cand, tg.bpm, coalesce(score, 0) AS score FROM (SELECT DISTINCT track_id FROM {src}) t CROSS JOIN tg LEFT JOIN {n}_sc s ON s.track_id = t.track_id AND s.cand = tg.cand),
{n}_rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, cand) AS rb, row_number() OVER (PARTITION BY track_id ORDER BY score, cand) AS ra FROM {n}_al),
{n}_b AS (SELECT track_id, max(bpm) FILTER (rb = 1) AS bpm, max(score) FILTER (rb = 1) AS score, max(score) FILTER (ra = 281) AS med FROM {n}_rk GROUP BY 1),
{n}_su AS (SELECT b.track_id, f, sum(salience * wt * CASE WHEN k * 60 / (bpm * f) <= 2.05 THEN greatest(0, 1 - abs(bin * 0.005::DOUBLE - k * 60 / (bpm * f)) / 0.025::DOUBLE) ELSE 0 END) AS v
   FROM {n}_b b JOIN {n}_hs USING (track_id) CROSS JOIN mu CROSS JOIN (VALUES (1.0::DOUBLE), (0.5), (2.0)) ff(f) WHERE bin >= 1 GROUP BY 1, 2),
{n}_st AS (SELECT track_id, count(*) AS n, max(cell / 100.0::DOUBLE) - min(cell / 100.0::DOUBLE) AS span FROM {src} GROUP BY 1),
{n}_pc AS (SELECT track_id, sum(pairs) AS pairs FROM {n}_hs GROUP BY 1),
{n}_e AS (SELECT st.track_id, n, span, pairs, b.bpm, score, score / greatest(med, 0.02 * score) AS prom,
    greatest(CASE WHEN b.bpm / 2 >= 60 THEN hf.v ELSE 0 END, CASE WHEN b.bpm * 2 <= 200 THEN db.v ELSE 0 END) >= 0.85 * ow.v AS amb
  FROM {n}_st st LEFT JOIN {n}_pc USING (track_id) LEFT JOIN {n}_b b USING (track_id) LEFT JOIN {n}_su ow ON ow.track_id = st.track_id AND ow.f = 1 LEFT JOIN {n}_su hf ON hf.track_id = st.track_id AND hf.f = 0.5 LEFT JOIN {n}_su db ON db.track_id = st.track_id AND db.f = 2),
{n} AS (SELECT track_id, n, span, CASE WHEN known THEN bpm ELSE 0 END AS bpm, CASE WHEN known THEN CASE WHEN amb THEN least(0.65, least(1, (prom - 1) / 4)) ELSE least(1, (prom - 1) / 4) END ELSE 0 END AS conf
  FROM (SELECT *, coalesce(n >= 8 AND span >= 4 AND pairs >= 40 AND score > 0 AND prom >= 2, FALSE) AS known FROM {n}_e))"""


@query("B20 G10 H2 J14 M6", "WITH RECURSIVE" + SCORE_SQL + tempo_sql("ons", "wh") + """,
md AS (SELECT track_id, (min(cell / 100.0::DOUBLE) + max(cell / 100.0::DOUBLE)) * 0.5 AS mid FROM ons GROUP BY 1),
el AS (SELECT track_id FROM wh WHERE conf >= 0.25 AND n >= 48 AND span >= 16),
o1 AS (SELECT ons.* FROM ons JOIN el USING (track_id) JOIN md USING (track_id) WHERE cell / 100.0::DOUBLE < mid),
o2 AS (SELECT ons.* FROM ons JOIN el USING (track_id) JOIN md USING (track_id) WHERE cell / 100.0::DOUBLE >= mid)""" + tempo_sql("o1", "h1") + tempo_sql("o2", "h2") + """,
v AS (SELECT wh.track_id, wh.n, wh.bpm, wh.conf, CASE WHEN h1.n IS NULL OR h2.n IS NULL OR h1.n < 16 OR h2.n < 16 THEN 'whole' WHEN h1.conf < 0.25 OR h2.conf < 0.25 THEN 'weak_half'
    WHEN abs(h1.bpm / h2.bpm - 1) < 0.03 THEN 'whole' WHEN abs(h1.bpm / h2.bpm - 2) < 0.06 OR abs(h1.bpm / h2.bpm - 0.5) < 0.015 THEN 'octave' ELSE 'conflict' END AS verdict
  FROM wh LEFT JOIN h1 USING (track_id) LEFT JOIN h2 USING (track_id)),
w AS (SELECT track_id, n, verdict, CASE WHEN verdict = 'conflict' THEN 0 ELSE bpm END AS bpm, conf * CASE verdict WHEN 'weak_half' THEN 0.8 WHEN 'octave' THEN 0.65 WHEN 'conflict' THEN 0 ELSE 1 END AS c FROM v)
SELECT track_id, n, verdict, bpm, R6(c) AS confidence, R6(CASE WHEN bpm > 0 AND c >= 0.25 THEN 1.0 * 60000 / bpm ELSE 250 END) AS quarter_release_ms FROM w""")
def tempo_decision(spark, root):
    d = onsets.tempo(ev_onset_times(spark, root), K)
    reliable = F.when(F.col("confidence") >= onsets.RELIABLE, F.col("bpm")).otherwise(0.0)
    return d.select("track_id", "n", "verdict", "bpm", rnd("confidence").alias("confidence"),
                    rnd(scalar.beat_release_ms(F.lit(1.0), reliable)).alias("quarter_release_ms"))


# --- frequency maps -----------------------------------------------------------

@query("B12 B14 B15 B19", """WITH p AS (SELECT p_partkey, p_retailprice AS hz, p_size FROM part WHERE p_retailprice > 0),
b AS (SELECT avg(log2(20 * pow(2, b / 12.0::DOUBLE) / 1000)) AS mean FROM (SELECT unnest(range(120)) AS b)),
x AS (SELECT *, 69 + 12 * log2(hz / 440) AS m, CASE p_size % 5 WHEN 0 THEN -9 WHEN 1 THEN -6 WHEN 2 THEN -3 WHEN 3 THEN 0 ELSE 3 END AS slope, least(119, greatest(0, CAST(floor(12 * log2(hz / 20) + 0.5) AS BIGINT))) AS band FROM p)
SELECT p_partkey, R6(log10(greatest(hz, 20) / 20) / 3 * 511) AS grid_index, R6(4.5 * log2(hz / 1000)) AS tilt_db, ((CAST(floor(m) AS BIGINT) % 12) + 12) % 12 AS pitch_class, R6(m - floor(m)) AS next_share, band,
  R6(slope * (log2(20 * pow(2, band / 12.0::DOUBLE) / 1000) - mean)) AS target_db FROM x CROSS JOIN b""")
def frequency_map(spark, root):
    """Grid position, display tilt, pitch class and tone target of a frequency."""
    p = table(spark, root, "part").where("p_retailprice > 0").select("p_partkey", F.col("p_retailprice").alias("hz"), "p_size")
    m = scalar.pitch_number(F.col("hz"))
    band = F.least(F.lit(119).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), scalar.half_up(12 * F.log2(F.col("hz") / 20))))
    # Target slopes in dB per octave, and the mean octave of 120 twelfth-octave bands.
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in (-9, -6, -3, 0, 3)]), F.col("p_size") % 5 + 1)
    mean = sum(math.log2(20 * 2 ** (b / 12) / 1000) for b in range(120)) / 120
    octave = F.log2(20 * F.pow(F.lit(2.0), F.col("band") / 12) / 1000)
    return p.withColumn("band", band).select(
        "p_partkey", rnd(scalar.grid_index(F.col("hz"))).alias("grid_index"), rnd(scalar.display_tilt_db(F.col("hz"))).alias("tilt_db"),
        F.pmod(F.floor(m), F.lit(12)).alias("pitch_class"), rnd(m - F.floor(m)).alias("next_share"), "band", rnd(slope * (octave - mean)).alias("target_db"))
