"""Window functions over the cells of each track."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, windows
from soundgrid.operators.blocks import previous_row
from soundgrid.queries.levels import CELLS_SQL, K
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, HOP, WB_SQL, event_samples, table, window_bands

DB = "10 * log10(greatest(1e-100, {}))"


def ev_hops(spark, root):
    """Dense 100 ms cells with energy, true length, power and peak."""
    l, r = F.col("l"), F.col("r")
    d = cells.dense_cells(event_samples(spark, root), K, "frame", HOP,
                          {"energy": F.sum(l * l + r * r), "peak": F.max(F.greatest(F.abs(l), F.abs(r)))}, "hop")
    return d.withColumn("power", F.col("energy") / F.col("n"))


HOPS_SQL = EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
spine AS (SELECT track_id, frames, unnest(range(0, (frames - 1) // 360 + 1)) AS hop FROM ext),
raw AS (SELECT track_id, frame // 360 AS hop, sum(l * l + r * r) AS energy, max(greatest(abs(l), abs(r))) AS peak FROM ev GROUP BY 1, 2),
hops AS (SELECT s.track_id, s.hop, least(360, s.frames - s.hop * 360) AS n, coalesce(energy, 0) AS energy, coalesce(peak, 0) AS peak,
           coalesce(energy, 0) / least(360, s.frames - s.hop * 360) AS power
         FROM spine s LEFT JOIN raw USING (track_id, hop))"""


@query("F1", "WITH" + HOPS_SQL + f""",
a AS (SELECT track_id, hop, avg(power) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s1 FROM hops),
b AS (SELECT track_id, hop, s1, avg(s1) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s2 FROM a)
SELECT track_id, hop, R6({DB.format('s1')}) AS once_db, R6({DB.format('s2')}) AS twice_db FROM b""")
def moving_average(spark, root):
    d = windows.moving_average(ev_hops(spark, root), K, "hop", "power", 5, "s1")
    d = windows.moving_average(d, K, "hop", "s1", 5, "s2")
    return d.select("track_id", "hop", rnd(scalar.power_db(F.col("s1"))).alias("once_db"), rnd(scalar.power_db(F.col("s2"))).alias("twice_db"))


@query("F2", "WITH" + HOPS_SQL + f""",
m AS (SELECT track_id, max(hop) AS top FROM hops GROUP BY 1),
o AS (SELECT unnest(range(-4, 5)) AS j)
SELECT h.track_id, h.hop, R6({DB.format('sum((5 - abs(j)) * x.power) / sum(5 - abs(j))')}) AS smooth_db
FROM hops h JOIN m USING (track_id) CROSS JOIN o JOIN hops x ON x.track_id = h.track_id AND x.hop = greatest(0, least(top, h.hop + j))
GROUP BY 1, 2""")
def triangular_smooth(spark, root):
    h = ev_hops(spark, root)
    top = h.groupBy("track_id").agg(F.max("hop").alias("top"))
    d = windows.triangular(h.join(top, "track_id"), K, "hop", "top", "power", 4, "s")
    return d.select("track_id", "hop", rnd(scalar.power_db(F.col("s"))).alias("smooth_db"))


@query("F3 F4", "WITH" + HOPS_SQL + f""",
w AS (SELECT track_id, sum(energy) OVER f / sum(n) OVER f AS p, count(*) OVER f AS c, count(*) OVER (PARTITION BY track_id) AS bins
      FROM hops WINDOW f AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT track_id, bins, R6({DB.format('max(p)')}) AS target_db FROM w WHERE c = least(30, bins) GROUP BY 1, 2""")
def macro_reference(spark, root):
    h = ev_hops(spark, root)
    d = windows.frame_mean(h, K, "hop", "energy", "n", {"p": (0, 30)})
    g = d.groupBy("track_id").agg(F.count("*").alias("bins"), F.max("p").alias("p"), (F.sum("energy") / F.sum("n")).alias("whole"))
    # A track shorter than the window uses all of it.
    return g.select("track_id", "bins", rnd(scalar.power_db(F.coalesce("p", "whole"))).alias("target_db"))


STEPS_SQL = HOPS_SQL + f""",
fl AS (SELECT track_id, greatest(-65, {DB.format('max(power) FILTER (rk = floor((c - 1) * 0.9::DOUBLE))')} - 35) AS lowest FROM
   (SELECT track_id, power, row_number() OVER (PARTITION BY track_id ORDER BY power) - 1 AS rk, count(*) OVER (PARTITION BY track_id) AS c FROM hops) GROUP BY 1),
ctx AS (SELECT track_id, hop,
   {DB.format('sum(energy) OVER a / sum(n) OVER a')} AS lft, {DB.format('sum(energy) OVER b / sum(n) OVER b')} AS rgt,
   abs({DB.format('sum(energy) OVER a1 / sum(n) OVER a1')} - {DB.format('sum(energy) OVER a2 / sum(n) OVER a2')}) AS ls,
   abs({DB.format('sum(energy) OVER b1 / sum(n) OVER b1')} - {DB.format('sum(energy) OVER b2 / sum(n) OVER b2')}) AS rs,
   count(*) OVER a AS ca, count(*) OVER b AS cb
  FROM hops WINDOW a AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
   b AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
   a1 AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), a2 AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
   b1 AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b2 AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING)),
nv AS (SELECT track_id, hop, CASE WHEN ca = 10 AND cb = 10 AND lft > lowest + 6 AND rgt > lowest + 6 AND ls < 1.5 AND rs < 1.5 AND abs(rgt - lft) >= 3
        THEN abs(rgt - lft) ELSE 0 END AS novelty FROM ctx JOIN fl USING (track_id)),
mx AS (SELECT track_id, hop, novelty, max(novelty) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS pl,
        max(novelty) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS pr FROM nv),
cand AS (SELECT track_id, hop, novelty FROM mx WHERE novelty > 0 AND novelty > coalesce(pl, -1) AND novelty >= coalesce(pr, -1) AND hop >= 20)"""


def level_step_candidates(spark, root):
    """Abrupt, lasting level changes: 1 s contexts on both sides, local maxima only."""
    from soundgrid.functions import quantiles

    h = materialise(ev_hops(spark, root))
    floor = quantiles.grouped(h, K, {"_p": ("power", 0.9, "floor")}).select("track_id", F.greatest(F.lit(-65.0), scalar.power_db(F.col("_p")) - 35).alias("floor"))
    spans = {"left": (-10, 0), "right": (0, 10), "l1": (-10, -5), "l2": (-5, 0), "r1": (0, 5), "r2": (5, 10)}
    d = windows.frame_mean(h, K, "hop", "energy", "n", spans)
    db = {s: scalar.power_db(F.col(s)) for s in spans}
    step = F.abs(db["right"] - db["left"])
    ok = (
        (db["left"] > F.col("floor") + 6) & (db["right"] > F.col("floor") + 6)
        & (F.abs(db["l1"] - db["l2"]) < 1.5) & (F.abs(db["r1"] - db["r2"]) < 1.5) & (step >= 3)
        & F.col("left").isNotNull() & F.col("right").isNotNull()
    )
    d = d.join(floor, "track_id").withColumn("novelty", F.when(ok, step).otherwise(F.lit(0.0)))
    return windows.local_maxima(d, K, "hop", "novelty", 10).where("is_max AND novelty > 0")


@query("C4 F5 F6", "WITH RECURSIVE" + STEPS_SQL + """,
pick AS (SELECT track_id, min(hop) AS hop FROM cand GROUP BY 1
         UNION ALL SELECT p.track_id, (SELECT min(c.hop) FROM cand c WHERE c.track_id = p.track_id AND c.hop >= p.hop + 20) AS hop FROM pick p WHERE p.hop IS NOT NULL)
SELECT p.track_id, p.hop, R6(c.novelty) AS step_db FROM pick p JOIN cand c ON c.track_id = p.track_id AND c.hop = p.hop""")
def level_steps(spark, root):
    c = materialise(level_step_candidates(spark, root).where("hop >= 20").select("track_id", "hop", "novelty"))
    kept = windows.greedy_gap(c, K, "hop", 20)
    return c.join(kept, ["track_id", "hop"]).select("track_id", "hop", rnd("novelty").alias("step_db"))


@query("F6", "WITH" + HOPS_SQL + f""",
x AS (SELECT track_id, hop, power, max(power) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pl,
   max(power) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS pr FROM hops)
SELECT track_id, hop, R6({DB.format('power')}) AS level_db FROM x WHERE power > 0 AND (pl IS NULL OR power > pl) AND (pr IS NULL OR power >= pr)""")
def local_maxima(spark, root):
    d = windows.local_maxima(ev_hops(spark, root), K, "hop", "power", 4).where("is_max AND power > 0")
    return d.select("track_id", "hop", rnd(scalar.power_db(F.col("power"))).alias("level_db"))


GAIN_SQL = HOPS_SQL + """,
gn AS (SELECT track_id, hop, CASE WHEN peak > 0.5 THEN 0.5 / peak ELSE 1 END AS gain FROM hops)"""


def ev_gains(spark, root, ceiling=0.5):
    p = F.col("peak")
    return ev_hops(spark, root).withColumn("gain", F.when(p > ceiling, ceiling / p).otherwise(F.lit(1.0)))


@query("F8", "WITH" + GAIN_SQL + """
SELECT track_id, hop, R9(gain) AS gain, R9(min(gain) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) AS held FROM gn""")
def sliding_min(spark, root):
    d = windows.forward_min(ev_gains(spark, root), K, "hop", "gain", 8, "held")
    return d.select("track_id", "hop", rnd("gain", 9).alias("gain"), rnd("held", 9).alias("held"))


@query("F11", "WITH" + GAIN_SQL + """,
l AS (SELECT track_id, hop, ln(gain) AS g, ln(10.0) / 20 * 2 AS rise, ln(10.0) / 20 * 6 AS attack FROM gn),
f AS (SELECT *, min(g - rise * hop) OVER (PARTITION BY track_id ORDER BY hop) + rise * hop AS g1 FROM l),
b AS (SELECT *, min(g1 + attack * hop) OVER (PARTITION BY track_id ORDER BY hop DESC) - attack * hop AS g2 FROM f)
SELECT track_id, hop, R6(g * 20 / ln(10.0)) AS wanted_db, R6(g2 * 20 / ln(10.0)) AS guard_db FROM b""")
def slew_limit(spark, root):
    per_db = math.log(10) / 20
    d = ev_gains(spark, root).withColumn("g", F.log("gain"))
    d = windows.slew_limit(d, K, "hop", "g", 2 * per_db, 6 * per_db, "g2")
    return d.select("track_id", "hop", rnd(F.col("g") / per_db).alias("wanted_db"), rnd(F.col("g2") / per_db).alias("guard_db"))


@query("E16", "WITH" + HOPS_SQL + """,
d AS (SELECT track_id, hop, abs(power - lag(power) OVER (PARTITION BY track_id ORDER BY hop)) AS q FROM hops QUALIFY q IS NOT NULL),
m AS (SELECT track_id, quantile_disc(q, 0.5) AS med, quantile_disc(q, 0.95) AS p95 FROM d GROUP BY 1),
a AS (SELECT track_id, quantile_disc(abs(q - med), 0.5) AS mad FROM d JOIN m USING (track_id) GROUP BY 1)
SELECT track_id, hop, R4(greatest(0, (q - med) / CASE WHEN mad > 0 THEN mad ELSE greatest(p95 - med, 1e-12) END)) AS novelty
FROM d JOIN m USING (track_id) JOIN a USING (track_id)""")
def robust_novelty(spark, root):
    d = previous_row(ev_hops(spark, root), K, "hop", {"before": "power"})
    d = d.where("before IS NOT NULL").withColumn("q", F.abs(F.col("power") - F.col("before")))
    return windows.robust_scale(d, K, "q", "v").select("track_id", "hop", rnd("v", 4).alias("novelty"))


@query("F7", """WITH d AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk, embedding AS e FROM embeddings),
u AS (SELECT label, vec_id, rk, unnest(range(1, len(e) + 1)) AS i, abs(CAST(unnest(e) AS DOUBLE)) AS v FROM d),
f AS (SELECT a.label, a.vec_id, sum(greatest(0, a.v - coalesce(b.v, 0))) AS flux FROM u a LEFT JOIN u b ON b.label = a.label AND b.rk = a.rk - 1 AND b.i = a.i GROUP BY 1, 2)
SELECT label, vec_id, R6(flux) AS flux, R6(CASE WHEN max(flux) OVER (PARTITION BY label) > 0 THEN flux / max(flux) OVER (PARTITION BY label) ELSE flux END) AS strength FROM f""")
def spectral_flux(spark, root):
    e = table(spark, root, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"))
    d = previous_row(e, ["label"], "vec_id", {"before": "m"})
    d = d.select("label", "vec_id", windows.positive_flux(F.col("m"), F.col("before")).alias("flux"))
    top = d.groupBy("label").agg(F.max("flux").alias("top"))
    s = F.when(F.col("top") > 0, F.col("flux") / F.col("top")).otherwise(F.col("flux"))
    return d.join(top, "label").select("label", "vec_id", rnd("flux").alias("flux"), rnd(s).alias("strength"))


@query("F18", "WITH" + WB_SQL + """,
t AS (SELECT track_id, win, band, (p_ll + p_rr) / 2 / sum((p_ll + p_rr) / 2) OVER (PARTITION BY track_id, win) AS f FROM wb),
u AS (SELECT track_id, win, band, f, 1 AS side FROM t UNION ALL SELECT track_id, win + 1, band, -f, -1 FROM t),
s AS (SELECT track_id, win, band, sum(f) AS d FROM u GROUP BY 1, 2, 3),
b AS (SELECT track_id, win FROM u GROUP BY 1, 2 HAVING count(DISTINCT side) = 2)
SELECT track_id, win, R6(sum(abs(d))) AS change FROM s JOIN b USING (track_id, win) GROUP BY 1, 2""")
def shape_change(spark, root):
    shapes = window_shapes(spark, root)
    d = previous_row(shapes, K, "win", {"w0": "win", "s0": "shape"}).where("w0 = win - 1")
    keys = F.array_union(F.map_keys("shape"), F.map_keys("s0"))
    zero = F.lit(0.0)
    change = F.aggregate(keys, zero, lambda a, k: a + F.abs(F.coalesce(F.col("shape")[k], zero) - F.coalesce(F.col("s0")[k], zero)))
    return d.select("track_id", "win", rnd(change).alias("change"))


def window_shapes(spark, root):
    """Normalised band shape of each window as a map band -> fraction."""
    wb = window_bands(spark, root).withColumn("p", (F.col("p_ll") + F.col("p_rr")) / 2)
    g = wb.groupBy("track_id", "win").agg(F.map_from_entries(F.collect_list(F.struct("band", "p"))).alias("m"), F.sum("p").alias("t"))
    return g.where("t > 0").select("track_id", "win", F.transform_values("m", lambda _, v: v / F.col("t")).alias("shape"))


BINS_SQL = HOPS_SQL + """,
tl AS (SELECT track_id, count(*) AS h FROM hops GROUP BY 1),
bins AS (SELECT track_id, b, b * h / 32.0 AS lo, (b + 1) * h / 32.0 AS hi FROM tl, (SELECT unnest(range(32)) AS b)),
rs AS (SELECT b.track_id, b, sum((least(hi, hop + 1) - greatest(lo, hop)) * power) / max(hi - lo) AS v
   FROM bins b JOIN hops x ON x.track_id = b.track_id AND x.hop < hi AND x.hop + 1 > lo GROUP BY 1, 2)"""


def ev_resampled(spark, root, bins=32):
    from soundgrid.operators.joins import overlap_resample

    h = ev_hops(spark, root)
    n = h.groupBy("track_id").agg(F.count("*").alias("len"))
    return overlap_resample(h.join(n, "track_id"), K, "hop", F.col("len"), "power", bins)


@query("D8", "WITH" + BINS_SQL + f"""
SELECT track_id, b AS bin, R6({DB.format('v')}) AS level_db FROM rs""")
def overlap_resample(spark, root):
    return ev_resampled(spark, root).select("track_id", "bin", rnd(scalar.power_db(F.col("value"))).alias("level_db"))


@query("F19 D8", "WITH" + BINS_SQL + """,
f AS (SELECT track_id, b, v <= 0 AS bad, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY b) AS isl FROM rs),
r AS (SELECT track_id, isl, count(*) FILTER (bad) AS len, count(*) FILTER (NOT bad) AS clear FROM f GROUP BY 1, 2)
SELECT track_id, CAST(max(len) AS BIGINT) AS longest_invalid, CAST(sum(clear) AS BIGINT) AS valid, max(len) <= 4 AND sum(clear) >= 24 AS usable FROM r GROUP BY 1""")
def valid_runs(spark, root):
    d = windows.longest_run(ev_resampled(spark, root), K, "bin", F.col("value") <= 0, "longest_invalid")
    return d.select("track_id", "longest_invalid", F.col("clear").alias("valid"), ((F.col("longest_invalid") <= 4) & (F.col("clear") >= 24)).alias("usable"))
