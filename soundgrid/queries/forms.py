"""Structure of tracks: novelty, boundaries, segments, pairs, references."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.operators import cells, loudness, structure
from soundgrid.queries.levels import K
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources.views import EV_SQL, event_samples, table

RATE, CELL, HOP = 900, 450, 90   # a slower clock: 48 s of structure per track
STEPS = (1, 3, 7, 15, 31, 63, 127)

FEAT_SQL = EV_SQL + """,
nn AS (SELECT track_id, max(frame) + 1 AS frames, max(frame) // 450 + 1 AS n FROM ev GROUP BY 1),
sp AS (SELECT track_id, frames, n, unnest(range(0, n)) AS idx FROM nn),
sm AS (SELECT track_id, frame // 450 AS idx, frame // 90 AS hop, CAST(floor(greatest(abs(l), abs(r)) * 100) AS BIGINT) % 12 AS pc, greatest(abs(l), abs(r)) * 100 AS x, l * l + r * r AS w FROM ev),
bd AS (SELECT *, CASE WHEN x >= 127 THEN 7 WHEN x >= 63 THEN 6 WHEN x >= 31 THEN 5 WHEN x >= 15 THEN 4 WHEN x >= 7 THEN 3 WHEN x >= 3 THEN 2 WHEN x >= 1 THEN 1 ELSE 0 END AS band FROM sm),
kc AS (SELECT unnest(range(12)) AS k), ks AS (SELECT unnest(range(8)) AS k),
c0 AS (SELECT sp.track_id, sp.idx, k, coalesce(sum(w), 0) AS v FROM sp CROSS JOIN kc LEFT JOIN bd ON bd.track_id = sp.track_id AND bd.idx = sp.idx AND bd.pc = k GROUP BY 1, 2, 3),
c1 AS (SELECT track_id, idx, k, greatest(0, v - nth_value(v, 2) OVER (PARTITION BY track_id, idx ORDER BY v, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM c0),
c2 AS (SELECT track_id, idx, k, CASE WHEN sqrt(sum(v * v) OVER w) > 1e-12 THEN v / sqrt(sum(v * v) OVER w) ELSE v END AS v FROM c1 WINDOW w AS (PARTITION BY track_id, idx)),
s0 AS (SELECT sp.track_id, sp.idx, k, ln(1 + coalesce(sum(w), 0)) AS v FROM sp CROSS JOIN ks LEFT JOIN bd ON bd.track_id = sp.track_id AND bd.idx = sp.idx AND bd.band = k GROUP BY 1, 2, 3),
s1 AS (SELECT track_id, idx, k, v - avg(v) OVER (PARTITION BY track_id, idx) AS v FROM s0),
s2 AS (SELECT track_id, idx, k, CASE WHEN sqrt(sum(v * v) OVER w) > 1e-12 THEN v / sqrt(sum(v * v) OVER w) ELSE v END AS v FROM s1 WINDOW w AS (PARTITION BY track_id, idx)),
rhp AS (SELECT track_id, hop, sum(w) AS e FROM bd GROUP BY 1, 2),
rmo AS (SELECT track_id, hop - k AS hop, sum(e) / 360 AS p FROM rhp CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE hop - k >= 0 GROUP BY 1, 2),
ram AS (SELECT track_id, hop // 5 AS idx, count(*) AS n FROM rmo JOIN nn USING (track_id) WHERE (hop + 4) * 90 <= frames AND p > 0 AND -0.691 + 10 * log10(p) > -70 GROUP BY 1, 2),
rcm AS (SELECT sp.track_id, sp.idx, least(5, floor((frames - 360) / 90) + 1 - sp.idx * 5) AS whole, coalesce(ram.n, 0) AS n FROM sp LEFT JOIN ram ON ram.track_id = sp.track_id AND ram.idx = sp.idx),
ac AS (SELECT rcm.track_id, rcm.idx, CASE WHEN whole > 0 THEN rcm.n / whole ELSE 0 END AS a, sqrt(coalesce(sum(w), 0)) AS m FROM rcm LEFT JOIN bd ON bd.track_id = rcm.track_id AND bd.idx = rcm.idx GROUP BY rcm.track_id, rcm.idx, whole, rcm.n),
fx AS (SELECT track_id, idx, greatest(0, m - lag(m, 1, 0::DOUBLE) OVER (PARTITION BY track_id ORDER BY idx)) AS f FROM ac),
vv AS (SELECT track_id, idx, k AS c, v FROM c2 UNION ALL SELECT track_id, idx, 12 + k, v FROM s2 UNION ALL SELECT track_id, idx, 20, a FROM ac UNION ALL SELECT track_id, idx, 21, f FROM fx)"""


def ev_features(spark, root):
    ev = event_samples(spark, root)
    x = F.greatest(F.abs("l"), F.abs("r")) * 100
    band = F.lit(0)
    for i, t in enumerate(STEPS, start=1):
        band = F.when(x >= t, i).otherwise(band)
    return structure.features(ev, K, CELL, HOP, F.floor(x) % 12, band, F.col("l") ** 2 + F.col("r") ** 2)


@query("D5 E14 E15 F7", "WITH" + FEAT_SQL + """ SELECT a.track_id, a.idx, R6(a.a) AS activity, R6(f) AS flux, R6(max(c.v)) AS top_chroma, R6(max(s.v)) AS top_shape
FROM ac a JOIN fx USING (track_id, idx) JOIN c2 c USING (track_id, idx) JOIN s2 s USING (track_id, idx) GROUP BY a.track_id, a.idx, a.a, f""")
def structure_cells(spark, root):
    return ev_features(spark, root).select(
        "track_id", "idx", rnd("activity").alias("activity"), rnd("flux").alias("flux"), rnd(F.array_max("chroma")).alias("top_chroma"), rnd(F.array_max("shape")).alias("top_shape"))


def novelty_sql(r: int) -> str:
    return f"""SELECT track_id, idx, c, {r} AS radius, quantile_disc(v, 0.5) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN {r} PRECEDING AND 1 PRECEDING) AS a,
  quantile_disc(v, 0.5) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN CURRENT ROW AND {r - 1} FOLLOWING) AS b FROM vv"""


DIST = """CASE WHEN sqrt({n1}) <= 1e-12 AND sqrt({n2}) <= 1e-12 THEN 0 WHEN sqrt({n1}) <= 1e-12 OR sqrt({n2}) <= 1e-12 THEN 1 ELSE {f} END"""
DC = DIST.format(n1="ca", n2="cb", f="1 - least(1, greatest(0, cd / (sqrt(ca) * sqrt(cb))))")
DS = DIST.format(n1="sa", n2="sb", f="(1 - least(1, greatest(-1, sd / (sqrt(sa) * sqrt(sb))))) / 2")
NOV_SQL = FEAT_SQL + f""",
md AS ({novelty_sql(4)} UNION ALL {novelty_sql(8)} UNION ALL {novelty_sql(16)}),
sq AS (SELECT track_id, idx, radius, sum(a * a) FILTER (c < 12) AS ca, sum(b * b) FILTER (c < 12) AS cb, sum(a * b) FILTER (c < 12) AS cd,
   sum(a * a) FILTER (c BETWEEN 12 AND 19) AS sa, sum(b * b) FILTER (c BETWEEN 12 AND 19) AS sb, sum(a * b) FILTER (c BETWEEN 12 AND 19) AS sd,
   max(abs(a - b)) FILTER (c = 20) AS da, max(abs(a - b) / (abs(a) + abs(b) + 1e-12)) FILTER (c = 21) AS df FROM md WHERE idx > 0 GROUP BY 1, 2, 3),
rw AS (SELECT track_id, idx, radius, 0.5 * ({DC}) + 0.3 * ({DS}) + 0.1 * da + 0.1 * df AS raw FROM sq),
q1 AS (SELECT track_id, radius, quantile_disc(raw, 0.5) AS med, quantile_disc(raw, 0.95) AS p95 FROM rw GROUP BY 1, 2),
q2 AS (SELECT track_id, radius, quantile_disc(abs(raw - med), 0.5) AS mad FROM rw JOIN q1 USING (track_id, radius) GROUP BY 1, 2),
nv AS MATERIALIZED (SELECT track_id, idx, sum(greatest(0, (raw - med) / CASE WHEN mad > 0 THEN mad ELSE greatest(p95 - med, 1e-12) END)) / 3 AS novelty FROM rw JOIN q1 USING (track_id, radius) JOIN q2 USING (track_id, radius) GROUP BY 1, 2)"""


@query("E16 F15", "WITH" + NOV_SQL + " SELECT track_id, idx, R6(ln(1 + novelty)) AS log_novelty FROM nv")
def structural_novelty(spark, root):
    return structure.novelty(materialise(ev_features(spark, root)), K).select("track_id", "idx", rnd(F.log1p("novelty")).alias("log_novelty"))


@query("F16", "WITH" + FEAT_SQL + f""",
w4 AS (SELECT track_id, idx, c, count(*) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS n,
   avg(v) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 5 PRECEDING) AS w0, avg(v) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS w1,
   avg(v) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w2, avg(v) OVER (PARTITION BY track_id, c ORDER BY idx ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS w3 FROM vv WHERE c < 20),
pr AS (SELECT track_id, idx, c, p, CASE p WHEN '12' THEN w1 WHEN '03' THEN w0 WHEN '01' THEN w0 ELSE w2 END AS a, CASE p WHEN '12' THEN w2 WHEN '03' THEN w3 WHEN '01' THEN w1 ELSE w3 END AS b FROM w4 CROSS JOIN (VALUES ('12'), ('03'), ('01'), ('23')) x(p) WHERE n = 16),
sq AS (SELECT track_id, idx, p, sum(a * a) FILTER (c < 12) AS ca, sum(b * b) FILTER (c < 12) AS cb, sum(a * b) FILTER (c < 12) AS cd, sum(a * a) FILTER (c >= 12) AS sa, sum(b * b) FILTER (c >= 12) AS sb, sum(a * b) FILTER (c >= 12) AS sd FROM pr GROUP BY 1, 2, 3),
ds AS (SELECT track_id, idx, p, 0.5 * ({DC}) + 0.3 * ({DS}) AS d FROM sq)
SELECT track_id, idx, R6(greatest(0, least(max(d) FILTER (p = '12'), max(d) FILTER (p = '03')) - 4 * max(d) FILTER (p IN ('01', '23')))) AS contrast FROM ds GROUP BY 1, 2""")
def persistent_contrast(spark, root):
    return structure.persistent_contrast(ev_features(spark, root), K).select("track_id", "idx", rnd("contrast").alias("contrast"))


SLOW_SQL = EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
hsp AS (SELECT track_id, frames, unnest(range(0, (frames - 1) // 90 + 1)) AS hop FROM ext),
hraw AS (SELECT track_id, frame // 90 AS hop, sum(l * l + r * r) AS energy FROM ev GROUP BY 1, 2),
hp AS (SELECT s.track_id, s.hop, least(90, s.frames - s.hop * 90) AS n, coalesce(energy, 0) AS energy FROM hsp s LEFT JOIN hraw USING (track_id, hop)),
st AS (SELECT track_id, hop, CASE WHEN sum(n) OVER w = 2700 AND sum(energy) OVER w > 0 THEN -0.691 + 10 * log10(sum(energy) OVER w / 2700) END AS s_lufs
  FROM hp WINDOW w AS (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))"""


def ev_short_term(spark, root):
    t = loudness.timeline(event_samples(spark, root), K, HOP)
    return t.select("track_id", "hop", scalar.lufs(F.col("s_power")).alias("s_lufs"))


@query("F17", "WITH" + SLOW_SQL + """,
sl AS (SELECT track_id, hop, hop // 5 AS idx, CASE WHEN count(s_lufs) OVER (PARTITION BY track_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) = 11 THEN
   (least(lead(s_lufs, 9) OVER w, lead(s_lufs, 10) OVER w) - least(s_lufs, lead(s_lufs, 1) OVER w)) / (9 * 0.1::DOUBLE) END AS slope FROM st WINDOW w AS (PARTITION BY track_id ORDER BY hop)),
c AS (SELECT track_id, idx, slope, lag(slope, 8) OVER w AS b, lead(slope, 8) OVER w AS la, lag(slope, 16) OVER w AS ea FROM (SELECT * FROM sl WHERE hop % 5 = 0) WINDOW w AS (PARTITION BY track_id ORDER BY idx))
SELECT track_id, idx, R6(greatest(
  CASE WHEN b IS NULL OR slope IS NULL OR la IS NULL OR abs(b) >= 0.1 OR sign(slope) <> sign(la) THEN 0 ELSE greatest(0, least(abs(slope), abs(la)) - 4 * abs(b) - 4 * abs(slope - la)) END,
  CASE WHEN b IS NULL OR slope IS NULL OR ea IS NULL OR abs(slope) >= 0.1 OR sign(b) <> sign(ea) THEN 0 ELSE greatest(0, least(abs(b), abs(ea)) - 4 * abs(slope) - 4 * abs(b - ea)) END)) AS ramp FROM c WHERE idx > 0""")
def loudness_ramps(spark, root):
    return structure.ramp_contrast(ev_short_term(spark, root), K, 5, 0.1).select("track_id", "idx", rnd("ramp").alias("ramp"))


@query("F6 H3 H4", "WITH" + NOV_SQL.replace("nv AS MATERIALIZED", "nv0 AS") + """,
nv AS MATERIALIZED (SELECT track_id, idx, R9(novelty) AS novelty FROM nv0),
lm AS (SELECT *, max(novelty) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pl, max(novelty) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS pr FROM nv),
cd AS (SELECT track_id, idx, novelty FROM lm WHERE novelty > 0 AND (pl IS NULL OR novelty > pl) AND (pr IS NULL OR novelty >= pr)),
n1 AS (SELECT track_id, quantile_disc(novelty, 0.5) AS med, quantile_disc(novelty, 0.95) AS p95, quantile_disc(novelty, 0.975) AS t1, quantile_disc(novelty, 0.99) AS t2 FROM nv GROUP BY 1),
n2 AS (SELECT track_id, quantile_disc(abs(novelty - med), 0.5) AS mad FROM nv JOIN n1 USING (track_id) GROUP BY 1),
th AS (SELECT track_id, unnest([0, 1, 2]) AS rung, unnest([CASE WHEN mad > 0 THEN med + 3 * mad ELSE p95 END, t1, t2]) AS t FROM n1 JOIN n2 USING (track_id)),
ct AS (SELECT th.track_id, rung, count(idx) AS n FROM th LEFT JOIN cd ON cd.track_id = th.track_id AND novelty > t GROUP BY 1, 2),
ok AS (SELECT track_id, min(rung) AS rung FROM ct WHERE n + 1 <= 4 GROUP BY 1)
SELECT n1.track_id, ok.rung IS NOT NULL AS ready, coalesce(ct.n, 0) AS boundaries, coalesce((SELECT string_agg(idx, '|' ORDER BY idx) FROM cd JOIN th USING (track_id) WHERE cd.track_id = n1.track_id AND th.rung = ok.rung AND novelty > t), '') AS positions
FROM n1 LEFT JOIN ok USING (track_id) LEFT JOIN ct ON ct.track_id = n1.track_id AND ct.rung = ok.rung""")
def boundary_ladder(spark, root):
    """Boundaries of the first threshold that keeps a track within four segments."""
    n = structure.novelty(materialise(ev_features(spark, root)), K).withColumn("novelty", rnd("novelty", 9))
    d = structure.ladder(n, K, "novelty")
    b = F.coalesce(*[F.when(F.size(f"b{i}") + 1 <= 4, F.col(f"b{i}")) for i in range(3)])
    return d.withColumn("b", b).select(
        "track_id", F.col("b").isNotNull().alias("ready"), F.coalesce(F.size("b"), F.lit(0)).cast("bigint").alias("boundaries"),
        F.coalesce(F.array_join(F.transform("b", lambda x: x.cast("string")), "|"), F.lit("")).alias("positions"))
