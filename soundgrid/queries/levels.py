"""Loudness, stereo statistics and gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import quantiles, scalar
from soundgrid.operators import cells, loudness
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, HOP, LI_SQL, event_samples, line_samples

K = ["track_id"]

CELLS_SQL = EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
spine AS (SELECT track_id, frames, unnest(range(0, (frames - 1) // 360 + 1)) AS hop FROM ext),
raw AS (SELECT track_id, frame // 360 AS hop, sum(l * l + r * r) AS energy FROM ev GROUP BY 1, 2),
hops AS (SELECT s.track_id, s.hop, least(360, s.frames - s.hop * 360) AS n, coalesce(energy, 0) AS energy
         FROM spine s LEFT JOIN raw USING (track_id, hop))"""

TIMELINE_SQL = CELLS_SQL + """,
tl AS (SELECT track_id, hop,
   CASE WHEN sum(n) OVER m = 1440 THEN sum(energy) OVER m / 1440 END AS m_power,
   CASE WHEN sum(n) OVER s = 10800 THEN sum(energy) OVER s / 10800 END AS s_power
  FROM hops
  WINDOW m AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING),
         s AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
lv AS (SELECT *, CASE WHEN m_power > 0 THEN -0.691 + 10 * log10(m_power) END AS m_lufs,
              CASE WHEN s_power > 0 THEN -0.691 + 10 * log10(s_power) END AS s_lufs FROM tl)"""


def ev_timeline(spark, root):
    return loudness.timeline(event_samples(spark, root), K, HOP)


@query("B2 C2 D1 D2 E3", "WITH" + TIMELINE_SQL + """,
a AS (SELECT track_id, -0.691 + 10 * log10(avg(m_power)) - 10 AS gate, count(*) AS n_absolute
      FROM lv WHERE m_lufs > -70 GROUP BY 1),
s AS (SELECT track_id, count(*) AS n_selected, avg(m_power) AS p
      FROM lv JOIN a USING (track_id) WHERE m_lufs > -70 AND m_lufs > gate GROUP BY 1),
c AS (SELECT track_id, count(*) AS n_blocks FROM lv WHERE m_power IS NOT NULL GROUP BY 1)
SELECT track_id, n_blocks, coalesce(n_absolute, 0) AS n_absolute, coalesce(n_selected, 0) AS n_selected,
       R6(-0.691 + 10 * log10(p)) AS lufs
FROM c LEFT JOIN a USING (track_id) LEFT JOIN s USING (track_id)""")
def integrated_loudness(spark, root):
    return loudness.integrated(ev_timeline(spark, root), K).withColumn("lufs", rnd("lufs"))


@query("D2 E4 B2 B3", "WITH" + TIMELINE_SQL + """
SELECT track_id, hop, R6(m_lufs) AS m_lufs, R6(s_lufs) AS s_lufs, R9(pow(10, (s_lufs + 0.691) / 10)) AS s_power_back FROM lv""")
def momentary_short_term(spark, root):
    s = scalar.lufs(F.col("s_power"))
    return ev_timeline(spark, root).select(
        "track_id", "hop", rnd(scalar.lufs(F.col("m_power"))).alias("m_lufs"), rnd(s).alias("s_lufs"),
        rnd(scalar.power_from_lufs(s), 9).alias("s_power_back"))


@query("E4", "WITH" + TIMELINE_SQL + """
SELECT track_id, R6(max(m_lufs)) AS max_momentary, R6(max(s_lufs)) AS max_short_term FROM lv GROUP BY 1""")
def loudness_maxima(spark, root):
    return ev_timeline(spark, root).groupBy("track_id").agg(
        rnd(scalar.lufs(F.max("m_power"))).alias("max_momentary"),
        rnd(scalar.lufs(F.max("s_power"))).alias("max_short_term"))


@query("E4", "WITH" + TIMELINE_SQL + """,
a AS (SELECT track_id, -0.691 + 10 * log10(avg(s_power)) - 20 AS gate FROM lv WHERE s_lufs > -70 GROUP BY 1),
k AS (SELECT track_id, s_lufs, row_number() OVER (PARTITION BY track_id ORDER BY s_lufs) - 1 AS rk, count(*) OVER (PARTITION BY track_id) AS n
      FROM lv JOIN a USING (track_id) WHERE s_lufs > -70 AND s_lufs >= gate)
SELECT track_id, n, R6(max(s_lufs) FILTER (rk = floor((n - 1) * 0.10::DOUBLE + 0.5::DOUBLE))) AS p10, R6(max(s_lufs) FILTER (rk = floor((n - 1) * 0.95::DOUBLE + 0.5::DOUBLE))) AS p95,
  R6(max(s_lufs) FILTER (rk = floor((n - 1) * 0.95::DOUBLE + 0.5::DOUBLE)) - max(s_lufs) FILTER (rk = floor((n - 1) * 0.10::DOUBLE + 0.5::DOUBLE))) AS lra
FROM k GROUP BY 1, 2""")
def loudness_range(spark, root):
    out = loudness.loudness_range(ev_timeline(spark, root), K)
    return out.select("track_id", "n", rnd("p10").alias("p10"), rnd("p95").alias("p95"), rnd("lra").alias("lra"))


@query("C3 G3", "WITH" + TIMELINE_SQL + """,
rg AS (SELECT track_id, event_id, frame AS start, frame + 10800 + CAST(floor(l * 10000) AS BIGINT) AS "end" FROM ev WHERE event_type = 'signup'),
inn AS (SELECT rg.track_id, event_id, s_lufs FROM rg JOIN lv ON rg.track_id = lv.track_id
        AND hop >= ceil(start / 360) AND hop <= floor(("end" - 10800) / 360)),
st AS (SELECT event_id, count(*) AS possible, count(s_lufs) AS valid,
          -0.691 + 10 * log10(avg(pow(10, (s_lufs + 0.691) / 10)) FILTER (s_lufs > -70)) - 20 AS gate FROM inn GROUP BY 1),
k AS (SELECT track_id, event_id, possible, valid, s_lufs FROM inn JOIN st USING (event_id)
      WHERE valid >= 3 AND valid * 2 >= possible AND s_lufs > -70 AND s_lufs > gate)
SELECT track_id, event_id, possible, valid, count(*) AS selected, R6(quantile_disc(s_lufs, 0.5)) AS lufs
FROM k GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""")
def regional_loudness(spark, root):
    ev = event_samples(spark, root)
    regions = ev.where("event_type = 'signup'").select(
        "track_id", "event_id", F.col("frame").alias("start"),
        (F.col("frame") + 10800 + F.floor(F.col("l") * 10000)).alias("end"))
    return loudness.regional(regions, ev_timeline(spark, root), K, ["event_id"], HOP).withColumn("lufs", rnd("lufs"))


# --- whole-track statistics -----------------------------------------------

def track_sums(samples):
    l, r = F.col("l"), F.col("r")
    return samples.groupBy("track_id").agg(
        F.count("*").alias("n"),
        F.sum(l * l).alias("ll"), F.sum(r * r).alias("rr"), F.sum(l * r).alias("lr"),
        F.sum(l).alias("dc_l"), F.sum(r).alias("dc_r"),
        F.max(F.abs(l)).alias("peak_l"), F.max(F.abs(r)).alias("peak_r"),
        F.sum((F.abs(l) > 1).cast("bigint")).alias("over_l"), F.sum((F.abs(r) > 1).cast("bigint")).alias("over_r"),
        F.sum(scalar.mid(l, r) * scalar.mid(l, r)).alias("mid"), F.sum(scalar.side(l, r) * scalar.side(l, r)).alias("side"),
    )


SUMS_SQL = LI_SQL + """,
ts AS (SELECT track_id, count(*) AS n, sum(l * l) AS ll, sum(r * r) AS rr, sum(l * r) AS lr, sum(l) AS dc_l, sum(r) AS dc_r,
  max(abs(l)) AS peak_l, max(abs(r)) AS peak_r, CAST(count(*) FILTER (abs(l) > 1) AS BIGINT) AS over_l, CAST(count(*) FILTER (abs(r) > 1) AS BIGINT) AS over_r,
  sum(pow((l + r) / 2, 2)) AS mid, sum(pow((l - r) / 2, 2)) AS side FROM li GROUP BY 1)"""


@query("E1 E2 B1 C1", "WITH" + SUMS_SQL + """
SELECT track_id, n, R9(ll / n) AS ll, R9(rr / n) AS rr, R9(lr / n) AS lr, R9(dc_l / n) AS dc_l, R9(dc_r / n) AS dc_r, peak_l, peak_r, over_l, over_r,
  R9(mid / n) AS mid_power, R9(side / n) AS side_power, R9(CASE WHEN sqrt(ll * rr) > 1e-12 THEN lr / sqrt(ll * rr) ELSE 1 END) AS correlation FROM ts""")
def track_stats(spark, root):
    s = line_samples(spark, root).where(~F.isnan("l") & ~F.isnan("r"))
    n = F.col("n")
    return track_sums(s).select(
        "track_id", "n", *[rnd(F.col(c) / n, 9).alias(c) for c in ("ll", "rr", "lr", "dc_l", "dc_r")],
        "peak_l", "peak_r", "over_l", "over_r", rnd(F.col("mid") / n, 9).alias("mid_power"), rnd(F.col("side") / n, 9).alias("side_power"),
        rnd(scalar.meter_correlation(F.col("ll"), F.col("rr"), F.col("lr")), 9).alias("correlation"))


@query("B1", "WITH" + LI_SQL + """
SELECT l_orderkey, l_linenumber, track_id, R9((l + r) / 2) AS mid, R9((l - r) / 2) AS side FROM li""")
def mid_side(spark, root):
    l, r = F.col("l"), F.col("r")
    return line_samples(spark, root).select(
        "l_orderkey", "l_linenumber", "track_id", rnd(scalar.mid(l, r), 9).alias("mid"), rnd(scalar.side(l, r), 9).alias("side"))


@query("B6 B7", "WITH" + SUMS_SQL + """,
x AS (SELECT track_id, mid / n AS m, side / n AS s, greatest(mid, side) / n AS z FROM ts)
SELECT track_id, R9(CASE WHEN z > 0 THEN (s / z) / (m / z + s / z) END) AS side_share,
  R9(CASE WHEN m > 0 AND s > 0 THEN exp(0.5 * (ln(m) - ln(s) + ln(0.12) - ln(1 - 0.12))) END) AS gain_to_target FROM x""")
def energy_share(spark, root):
    m, s = F.col("mid") / F.col("n"), F.col("side") / F.col("n")
    return track_sums(line_samples(spark, root)).select(
        "track_id", rnd(scalar.energy_share(m, s), 9).alias("side_share"),
        rnd(scalar.side_gain_for_share(m, s, 0.12), 9).alias("gain_to_target"))


STATE_SQL = """CASE WHEN ll + rr = 0 THEN 'silence' WHEN ll = 0 THEN 'left_absent' WHEN rr = 0 THEN 'right_absent'
  WHEN greatest(0, (ll + rr - 2 * lr) / 4) = 0 THEN 'dual_mono' WHEN greatest(0, (ll + rr + 2 * lr) / 4) = 0 THEN 'antiphase' ELSE 'stereo' END"""

STEREO_CELLS_SQL = EV_SQL + """,
sc AS (SELECT track_id, frame // 360 AS cell, count(*) AS n, sum(l * l) AS ll, sum(r * r) AS rr, sum(l * r) AS lr FROM ev GROUP BY 1, 2)"""


def lr_sums():
    l, r = F.col("l"), F.col("r")
    return {"ll": F.sum(l * l), "rr": F.sum(r * r), "lr": F.sum(l * r)}


def stereo_cells(spark, root):
    return cells.cells(event_samples(spark, root), K, "frame", HOP, {"n": F.count("*"), **lr_sums()})


@query("B5 D5", "WITH" + STEREO_CELLS_SQL + f"""
SELECT track_id, {STATE_SQL} AS state, count(*) AS cells, CAST(sum(n) AS BIGINT) AS samples FROM sc GROUP BY 1, 2""")
def stereo_state_counts(spark, root):
    ll, rr, lr = F.col("ll"), F.col("rr"), F.col("lr")
    return (
        stereo_cells(spark, root)
        .groupBy("track_id", scalar.stereo_state(ll, rr, lr).alias("state"))
        .agg(F.count("*").alias("cells"), F.sum("n").alias("samples"))
    )


@query("B4 B5 E2", "WITH" + STEREO_CELLS_SQL + """,
p AS (SELECT *, greatest(0, (ll + rr + 2 * lr) / 4) AS m, greatest(0, (ll + rr - 2 * lr) / 4) AS s FROM sc)
SELECT track_id, cell, CASE WHEN m = 0 AND s = 0 THEN NULL WHEN m = 0 THEN '+inf' WHEN s = 0 THEN '-inf' ELSE 'finite' END AS side_mid_state,
  R6(CASE WHEN m > 0 AND s > 0 THEN 10 * log10(s / m) END) AS side_mid_db,
  CASE WHEN ll = 0 AND rr = 0 THEN NULL WHEN rr = 0 THEN '+inf' WHEN ll = 0 THEN '-inf' ELSE 'finite' END AS balance_state,
  R6(CASE WHEN ll > 0 AND rr > 0 THEN 10 * log10(ll / rr) END) AS balance_db,
  R6(CASE WHEN sqrt(ll * rr) > 0 THEN least(1, greatest(-1, lr / sqrt(ll * rr))) END) AS correlation FROM p""")
def stereo_descriptors(spark, root):
    ll, rr, lr = F.col("ll"), F.col("rr"), F.col("lr")
    m, s = scalar.mid_power(ll, rr, lr), scalar.side_power(ll, rr, lr)
    return stereo_cells(spark, root).select(
        "track_id", "cell", scalar.ratio_state(s, m).alias("side_mid_state"), rnd(scalar.ratio_db(s, m)).alias("side_mid_db"),
        scalar.ratio_state(ll, rr).alias("balance_state"), rnd(scalar.ratio_db(ll, rr)).alias("balance_db"),
        rnd(scalar.correlation(ll, rr, lr)).alias("correlation"))


# --- windows and gates ----------------------------------------------------

WIN_SQL = EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
e2 AS (SELECT *, CASE WHEN frames >= 10800 THEN (frames - 10800) // 5400 + 1 ELSE 0 END AS nfull FROM ext),
wn AS (SELECT track_id, frames, nfull, unnest(range(0, nfull + CASE WHEN frames > nfull * 5400 AND frames > CASE WHEN nfull > 0 THEN (nfull - 1) * 5400 + 10800 ELSE 0 END THEN 1 ELSE 0 END)) AS win FROM e2),
ws AS (SELECT track_id, win, win * 5400 AS start, least(win * 5400 + 10800, frames) AS "end", win >= nfull AS "partial" FROM wn),
wp AS (SELECT ws.track_id, win, start, "end", "partial", coalesce(sum(l * l), 0) / ("end" - start) AS ll, coalesce(sum(r * r), 0) / ("end" - start) AS rr, coalesce(sum(l * r), 0) / ("end" - start) AS lr
  FROM ws LEFT JOIN ev ON ws.track_id = ev.track_id AND frame >= start AND frame < "end" GROUP BY 1, 2, 3, 4, 5),
wm AS (SELECT *, greatest(0, (ll + rr + 2 * lr) / 4) AS mid, greatest(0, (ll + rr - 2 * lr) / 4) AS side FROM wp)"""


def ev_windows(spark, root, size=10800, hop=5400):
    """3 s windows every 1.5 s with their mean powers."""
    w = cells.overlapping_windows(event_samples(spark, root), K, "frame", size, hop, lr_sums())
    n = F.col("end") - F.col("start")
    w = w.withColumns({c: F.col(c) / n for c in ("ll", "rr", "lr")})
    args = F.col("ll"), F.col("rr"), F.col("lr")
    return w.withColumns({"mid": scalar.mid_power(*args), "side": scalar.side_power(*args)})


@query("D3 D6", "WITH" + WIN_SQL + """
SELECT track_id, win, start, "end", "partial", R9(ll) AS ll, R9(rr) AS rr, R9(lr) AS lr, R9(mid) AS mid_power, R9(side) AS side_power FROM wm""")
def overlapping_windows(spark, root):
    return ev_windows(spark, root).select(
        "track_id", "win", "start", "end", "partial", *[rnd(c, 9).alias(c) for c in ("ll", "rr", "lr")],
        rnd("mid", 9).alias("mid_power"), rnd("side", 9).alias("side_power"))


@query("C5 B4", "WITH" + WIN_SQL + f""",
g AS (SELECT track_id, quantile_cont(mid + side, 0.95) AS p95 FROM wm GROUP BY 1),
t AS (SELECT track_id, gate, CASE WHEN drop_db IS NULL THEN 1e-8 ELSE greatest(1e-8, p95 * pow(10, -drop_db / 10.0)) END AS threshold
      FROM g, (VALUES ('absolute_minus_80_dbfs', NULL), ('p95_minus_10_db', 10), ('p95_minus_20_db', 20), ('p95_minus_40_db', 40)) v(gate, drop_db)),
s AS (SELECT t.track_id, gate, threshold, CASE WHEN mid > 0 AND side > 0 THEN 10 * log10(side / mid) END AS db,
      mid IS NOT NULL AND mid + side >= threshold AS sel FROM t JOIN wm USING (track_id))
SELECT track_id, gate, R6(10 * log10(threshold)) AS threshold_db, CAST(count(*) FILTER (sel) AS BIGINT) AS selected_windows, count(db) FILTER (sel) AS finite_windows,
  R6(quantile_cont(db, 0.1) FILTER (sel)) AS p10, R6(quantile_cont(db, 0.5) FILTER (sel)) AS p50, R6(quantile_cont(db, 0.9) FILTER (sel)) AS p90
FROM s GROUP BY track_id, gate, threshold""")
def gate_sensitivity(spark, root):
    w = materialise(ev_windows(spark, root).select("track_id", "mid", "side", (F.col("mid") + F.col("side")).alias("_e")))
    p95 = quantiles.grouped(w, K, {"_p95": ("_e", 0.95, "linear")})
    floor = F.lit(1e-8)
    # The drops below the 95th percentile, in dB.
    gates = F.array(
        F.struct(F.lit("absolute_minus_80_dbfs").alias("gate"), floor.alias("threshold")),
        *[
            F.struct(F.lit(f"p95_minus_{d}_db").alias("gate"), F.greatest(floor, F.col("_p95") * F.pow(F.lit(10.0), F.lit(-d / 10.0))).alias("threshold"))
            for d in (10, 20, 40)
        ],
    )
    t = p95.select("track_id", F.inline(gates))
    sel = F.col("_e") >= F.col("threshold")
    db = F.when(sel, scalar.ratio_db(F.col("side"), F.col("mid")))
    d = materialise(w.join(t, "track_id").select("track_id", "gate", "threshold", sel.alias("_in"), db.alias("_db")))
    keys = ["track_id", "gate", "threshold"]
    n = d.groupBy(*keys).agg(F.sum(F.col("_in").cast("bigint")).alias("selected_windows"), F.count("_db").alias("finite_windows"))
    q = quantiles.grouped(d, keys, {f"p{p}": ("_db", p / 100, "linear") for p in (10, 50, 90)})
    return n.join(q, keys).select(
        "track_id", "gate", rnd(10 * F.log10("threshold")).alias("threshold_db"), "selected_windows", "finite_windows", *[rnd(c).alias(c) for c in ("p10", "p50", "p90")])


@query("C4 C6 C7", "WITH" + CELLS_SQL + """,
p AS (SELECT track_id, energy / n AS power, row_number() OVER (PARTITION BY track_id ORDER BY energy / n) - 1 AS rk, count(*) OVER (PARTITION BY track_id) AS c FROM hops)
SELECT track_id, c AS cells, R6(greatest(-65, 10 * log10(greatest(1e-100, max(power) FILTER (rk = floor((c - 1) * 0.9::DOUBLE)))) - 35)) AS activity_floor_db,
  R9(greatest(1e-6, quantile_cont(power, 0.95) / 10)) AS research_gate, R9(greatest(1e-8, quantile_cont(power, 0.95) * 1e-4)) AS tonal_gate,
  CAST(count(*) FILTER (power >= 1e-8) AS BIGINT) AS active_cells
FROM p GROUP BY 1, 2""")
def gate_thresholds(spark, root):
    d = cells.dense_cells(event_samples(spark, root), K, "frame", HOP, {"energy": F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r"))}, "hop")
    d = materialise(d.select("track_id", (F.col("energy") / F.col("n")).alias("power")))
    g = d.groupBy("track_id").agg(F.count("*").alias("cells"), F.sum((F.col("power") >= 1e-8).cast("bigint")).alias("active_cells"))
    g = g.join(quantiles.grouped(d, K, {"_p90": ("power", 0.9, "floor"), "_p95": ("power", 0.95, "linear")}), "track_id")
    return g.select(
        "track_id", "cells", rnd(F.greatest(F.lit(-65.0), scalar.power_db(F.col("_p90")) - 35)).alias("activity_floor_db"),
        rnd(F.greatest(F.lit(1e-6), F.col("_p95") / 10), 9).alias("research_gate"),
        rnd(F.greatest(F.lit(1e-8), F.col("_p95") * 1e-4), 9).alias("tonal_gate"), "active_cells")


@query("D6", "WITH" + WIN_SQL + """,
b AS (SELECT track_id, frames, unnest(range(0, (frames - 1) // 7200 + 1)) AS bin FROM ext)
SELECT b.track_id, bin, bin * 7200 AS start, least((bin + 1) * 7200, frames) AS "end", count(win) AS windows,
  count(CASE WHEN mid > 0 AND side > 0 THEN 1 END) AS finite_windows, R6(quantile_cont(CASE WHEN mid > 0 AND side > 0 THEN 10 * log10(side / mid) END, 0.5)) AS side_mid_p50
FROM b LEFT JOIN (SELECT * FROM wm WHERE NOT "partial") w ON b.track_id = w.track_id AND (w.start + w."end") / 2 >= bin * 7200 AND (w.start + w."end") / 2 < (bin + 1) * 7200
GROUP BY b.track_id, bin, frames""")
def macro_bins(spark, root):
    width = 7200
    ev = event_samples(spark, root)
    spine = cells.bin_spine(cells.extents(ev, K, "frame"), K, "frames", width)
    w = ev_windows(spark, root).where("NOT partial").select(
        "track_id", F.floor((F.col("start") + F.col("end")) / 2 / width).alias("bin"),
        F.lit(1).alias("_w"), scalar.ratio_db(F.col("side"), F.col("mid")).alias("_db"))
    return (
        spine.join(w, ["track_id", "bin"], "left")
        .groupBy("track_id", "bin", "frames")
        .agg(F.count("_w").alias("windows"), F.count("_db").alias("finite_windows"), rnd(quantiles.linear("_db", 0.5)).alias("side_mid_p50"))
        .select("track_id", "bin", (F.col("bin") * width).alias("start"),
                F.least((F.col("bin") + 1) * width, F.col("frames")).alias("end"), "windows", "finite_windows", "side_mid_p50")
    )
