"""Catalogue sources and the corpus study."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import quantiles, scalar
from soundgrid.operators import cells
from soundgrid.plans import capture, corpus, presets
from soundgrid.queries.levels import K, lr_sums
from soundgrid.queries.registry import query, rnd
from soundgrid.session import materialise
from soundgrid.sources import catalogue
from soundgrid.sources.views import EV_SQL, WB_SQL, event_samples, table, window_bands

# --- sources ------------------------------------------------------------------


@query("A1", """WITH f AS (SELECT 'documents' AS folder, encode(text) AS b FROM documents UNION ALL SELECT 'pages', encode(html) FROM pages)
SELECT folder, CASE WHEN hex(b[1:4]) = '52494646' AND hex(b[9:12]) = '57415645' THEN 'wav' WHEN hex(b[1:3]) = '494433' OR (hex(b[1:1]) = 'FF' AND hex(b[2:2]) >= 'E0') THEN 'mp3' ELSE 'unknown' END AS kind,
  count(*) AS files, CAST(sum(octet_length(b)) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""")
def catalogue_scan(spark, root):
    d = table(spark, root, "documents").select(F.lit("documents").alias("folder"), F.encode("text", "UTF-8").alias("b"))
    p = table(spark, root, "pages").select(F.lit("pages").alias("folder"), F.encode("html", "UTF-8").alias("b"))
    return d.unionByName(p).groupBy("folder", catalogue.kind(F.col("b")).alias("kind")).agg(
        F.count("*").alias("files"), F.sum(F.octet_length("b").cast("bigint")).alias("bytes"))


@query("A3", "SELECT doc_id, sha256(text) AS sha256, sha256(lang || '|' || source || '|' || n_chars) AS format_sha256 FROM documents")
def content_identity(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.sha2(F.concat_ws("|", "lang", "source", "n_chars"), 256).alias("format_sha256"))


@query("G12", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, root):
    return table(spark, root, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("A4", """SELECT user_id, count(*) AS records, CAST(count(k) AS BIGINT) AS finite, min(k) AS min_k, max(k) AS max_k, CAST(sum(k) AS BIGINT) AS sum_k
FROM (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def nested_measurements(spark, root):
    e = table(spark, root, "events").select("user_id", F.from_json("props", "k bigint").alias("m"))
    return e.groupBy("user_id").agg(
        F.count("*").alias("records"), F.count("m.k").alias("finite"), F.min("m.k").alias("min_k"), F.max("m.k").alias("max_k"), F.sum("m.k").alias("sum_k"))


INC_SQL = """WITH src AS (SELECT doc_id, sha256(text) AS source_sha256, '1' AS analyser, sha256(source || '|' || lang) AS provenance_sha256 FROM documents),
res AS (SELECT d.doc_id, sha256(d.text) AS source_sha256, CAST(quality AS VARCHAR) AS analyser, sha256(CASE WHEN toxic = 1 THEN upper(source) ELSE source END || '|' || lang) AS provenance_sha256
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
j AS (SELECT s.doc_id, s.source_sha256, CASE WHEN r.doc_id IS NULL THEN 'todo' WHEN s.source_sha256 = r.source_sha256 AND s.analyser = r.analyser AND s.provenance_sha256 = r.provenance_sha256 THEN 'cached' ELSE 'stale' END AS status
  FROM src s LEFT JOIN res r ON r.doc_id = s.doc_id)"""


def incremental(spark, root):
    """Documents are the sources; labelled ones have a result of an earlier analyser or provenance."""
    d = table(spark, root, "documents")
    sha = F.sha2("text", 256).alias("source_sha256")
    src = d.select("doc_id", sha, F.lit("1").alias("analyser"), F.sha2(F.concat_ws("|", "source", "lang"), 256).alias("provenance_sha256"))
    owner = F.when(F.col("toxic") == 1, F.upper("source")).otherwise(F.col("source"))
    res = table(spark, root, "labels").join(d, "doc_id").select(
        "doc_id", sha, F.col("quality").cast("string").alias("analyser"), F.sha2(F.concat_ws("|", owner, "lang"), 256).alias("provenance_sha256"))
    return catalogue.split_incremental(src, res, "doc_id", ["source_sha256", "analyser", "provenance_sha256"])


@query("A5", INC_SQL + " SELECT doc_id, source_sha256 FROM j WHERE status = 'todo'")
def incremental_todo(spark, root):
    return incremental(spark, root).where("status = 'todo'").select("doc_id", "source_sha256")


@query("A5", INC_SQL + " SELECT doc_id, status FROM j WHERE status <> 'todo'")
def incremental_skip(spark, root):
    return incremental(spark, root).where("status <> 'todo'").select("doc_id", "status")


@query("A6", r"""WITH s AS (SELECT page_id, url, '/' || regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') || '.wav' AS stem, regexp_extract(url, '^https?://[^/]*') AS folder FROM pages),
t AS (SELECT *, folder || stem AS target FROM s)
SELECT page_id, target, count(*) OVER (PARTITION BY lower(target)) AS same_name, CASE WHEN target IN (SELECT url FROM pages) THEN 'replaces_source' WHEN count(*) OVER (PARTITION BY lower(target)) > 1 THEN 'name_collision' END AS problem FROM t""")
def output_plan(spark, root):
    p = table(spark, root, "pages").select("page_id", "url")
    d = catalogue.output_plan(p, "url", F.regexp_extract("url", "^https?://[^/]*", 0), ".wav")
    return d.select("page_id", "target", "same_name", "problem")


@query("A9", """WITH e AS (SELECT c_custkey, lower(replace(c_name, '#', '-')) || CASE WHEN c_acctbal < -500 THEN '!' ELSE '' END AS id, '/' || n_name || '/' || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS path,
   'technical_pilot' AS role, c_nationkey = 7 AS eligible, CASE c_mktsegment WHEN 'BUILDING' THEN 'CC-BY-4.0' WHEN 'HOUSEHOLD' THEN 'CC-BY-3.0' WHEN 'MACHINERY' THEN 'unknown' ELSE 'user_owned_authorized' END AS permission, CASE WHEN c_acctbal > 9000 THEN '' ELSE n_name END AS artist
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY lower(path)) AS paths FROM e)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT (regexp_full_match(id, '[a-z0-9][a-z0-9_-]*') AND ids = 1) THEN 'unsafe_or_duplicate_id' END, CASE WHEN role <> 'technical_pilot' OR eligible THEN 'not_a_technical_pilot' END,
  CASE WHEN permission NOT IN ('CC-BY-4.0', 'CC-BY-3.0', 'user_owned_authorized') THEN 'permission_needs_review' END, CASE WHEN length(artist) = 0 THEN 'missing_provenance' END, CASE WHEN paths > 1 THEN 'duplicate_path' END], lambda v: v IS NOT NULL), '|') AS errors FROM x""")
def manifest_errors(spark, root):
    n = table(spark, root, "nation")
    c = table(spark, root, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.col("c_mktsegment")
    e = c.select(
        "c_custkey", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.when(F.col("c_acctbal") < -500, "!").otherwise("")).alias("id"),
        F.concat(F.lit("/"), "n_name", F.lit("/"), F.floor(F.abs("c_acctbal")).cast("string")).alias("path"), F.lit("technical_pilot").alias("role"),
        (F.col("c_nationkey") == 7).alias("eligible"),
        F.when(seg == "BUILDING", "CC-BY-4.0").when(seg == "HOUSEHOLD", "CC-BY-3.0").when(seg == "MACHINERY", "unknown").otherwise("user_owned_authorized").alias("permission"),
        F.when(F.col("c_acctbal") > 9000, "").otherwise(F.col("n_name")).alias("artist"), F.col("n_name").alias("source_page"))
    return catalogue.manifest_errors(e).select("c_custkey", F.array_join("errors", "|").alias("errors"))


@query("B18", """WITH p AS (SELECT c_custkey, c_acctbal / 10000 AS leveling, -CAST(c_nationkey AS DOUBLE) AS peak_reduction, c_acctbal / 100 AS fade_in, c_nationkey AS os,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'PINK' WHEN 'HOUSEHOLD' THEN 'WHITE' WHEN 'MACHINERY' THEN 'GREY' END AS eq_target,
   CASE WHEN c_nationkey % 4 = 0 THEN ['Limit', 'EQ', 'Clip', 'Dynamics'] WHEN c_nationkey % 4 = 1 THEN ['EQ', 'EQ', 'Clip', 'Limit'] WHEN c_nationkey % 4 = 2 THEN [] ELSE ['EQ', 'Stereo Image', 'Dynamics', 'Clip', 'Limit'] END AS co,
   abs(c_acctbal) AS hz, c_acctbal / 300 AS gain FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT fade_in BETWEEN 0 AND 60 THEN 'fade_in' END, CASE WHEN NOT peak_reduction BETWEEN -18 AND 0 THEN 'peak_reduction' END, CASE WHEN NOT leveling BETWEEN 0 AND 1 THEN 'leveling' END,
  CASE WHEN eq_target = 'GREY' THEN 'eq_target' END, CASE WHEN os NOT IN (1, 2, 4, 8, 16) THEN 'oversampling' END, CASE WHEN list_contains(co, 'EQ') AND list_sort(co) = ['EQ', 'EQ', 'Clip', 'Limit'].list_sort() THEN 'chain_order' END,
  CASE WHEN NOT (hz BETWEEN 20 AND 20000 AND gain BETWEEN -24 AND 24) THEN 'bands' END], lambda v: v IS NOT NULL), '|') AS errors FROM p""")
def preset_errors(spark, root):
    """Customers read as presets, so that every rule is broken by some of them."""
    bal, seg, nk = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")

    def names(*v):
        return F.array(*[F.lit(x) for x in v])

    chain = (
        F.when(nk % 4 == 0, names("Limit", "EQ", "Clip", "Dynamics")).when(nk % 4 == 1, names("EQ", "EQ", "Clip", "Limit"))
        .when(nk % 4 == 2, F.array().cast("array<string>")).otherwise(names("EQ", "Stereo Image", "Dynamics", "Clip", "Limit")))
    fixed = {"q": 1.0, "threshold": -20.0, "above_range": 3.0, "below_range": 3.0, "above_ratio": 2.0, "below_ratio": 2.0, "above_attack": 5.0,
             "below_attack": 5.0, "above_release": 50.0, "below_release": 50.0}
    band = F.struct(F.abs(bal).alias("frequency"), (bal / 300).alias("gain_db"), F.lit(12).alias("slope"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    p = table(spark, root, "customer").select(
        "c_custkey", (bal / 10000).alias("leveling"), (-nk.cast("double")).alias("peak_reduction"), (bal / 100).alias("fade_in"), nk.alias("oversampling"),
        F.when(seg == "BUILDING", "PINK").when(seg == "HOUSEHOLD", "WHITE").when(seg == "MACHINERY", "GREY").alias("eq_target"), chain.alias("chain_order"), F.array(band).alias("bands"))
    return p.select("c_custkey", F.array_join(presets.preset_errors(p.columns), "|").alias("errors"))


# --- band features --------------------------------------------------------------

NB = 7
DENSE_SQL = WB_SQL + """,
db AS (SELECT s.track_id, s.win, s.band, coalesce(p_ll, 0) AS p_ll, coalesce(p_rr, 0) AS p_rr, coalesce(p_lr, 0) AS p_lr
  FROM (SELECT * FROM (SELECT DISTINCT track_id, win FROM wb) CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS band)) s LEFT JOIN wb USING (track_id, win, band)),
cp AS (SELECT *, greatest(0, (p_ll + p_rr + 2 * p_lr) / 4) AS mid, greatest(0, (p_ll + p_rr - 2 * p_lr) / 4) AS side FROM db),
tt AS (SELECT track_id, win, sum((p_ll + p_rr) / 2) AS total FROM db GROUP BY 1, 2),
aw AS (SELECT track_id, win, total FROM tt JOIN (SELECT track_id, greatest(1e-8, quantile_cont(total, 0.95) * 1e-4) AS gate FROM tt GROUP BY 1) USING (track_id) WHERE total >= gate)"""


def wb_dense(spark, root):
    return corpus.dense_bands(materialise(window_bands(spark, root)), K, NB)


@query("C9", "WITH" + WB_SQL + """ SELECT track_id, count(*) AS bands, CAST(count(*) FILTER (p_ll < 0 OR p_rr < 0 OR abs(p_lr) > sqrt(p_ll * p_rr) + (p_ll + p_rr) * 1e-12) AS BIGINT) AS violations FROM wb GROUP BY 1""")
def band_integrity(spark, root):
    bad = corpus.impossible(F.col("p_ll"), F.col("p_rr"), F.col("p_lr"))
    return window_bands(spark, root).groupBy("track_id").agg(F.count("*").alias("bands"), F.sum(bad.cast("bigint")).alias("violations"))


@query("E10", "WITH" + DENSE_SQL + """,
w AS (SELECT track_id, count(DISTINCT win) AS n FROM db GROUP BY 1),
g AS (SELECT track_id, band, n AS windows, sum(p_ll) / n AS ll, sum(p_rr) / n AS rr, sum(p_lr) / n AS lr FROM db JOIN w USING (track_id) GROUP BY 1, 2, 3),
h AS (SELECT *, greatest(0, (ll + rr + 2 * lr) / 4) AS m, greatest(0, (ll + rr - 2 * lr) / 4) AS s FROM g)
SELECT track_id, band, windows, R6(m) AS mid, R6(s) AS side, R6(m / sum(m) OVER (PARTITION BY track_id)) AS mid_fraction, R6(s / sum(s) OVER (PARTITION BY track_id)) AS side_fraction FROM h""")
def pooled_spectrum(spark, root):
    d = corpus.pooled(wb_dense(spark, root), K)
    return d.select("track_id", "band", "windows", *[rnd(c).alias(c) for c in ("mid", "side", "mid_fraction", "side_fraction")])


@query("B4 E10", "WITH" + DENSE_SQL + """,
g AS (SELECT track_id, band, sum(p_ll) AS ll, sum(p_rr) AS rr, sum(p_lr) AS lr, count(*) AS n FROM db GROUP BY 1, 2),
h AS (SELECT track_id, [120, 200, 250, 300, 2000, 10000, 1000000][band + 1] AS hi, greatest(0, (ll + rr + 2 * lr) / 4) / n AS m, greatest(0, (ll + rr - 2 * lr) / 4) / n AS s FROM g),
c AS (SELECT track_id, cutoff, sum(m) AS tm, sum(s) AS ts, sum(m) FILTER (hi <= cutoff) AS lm, sum(s) FILTER (hi <= cutoff) AS ls FROM h CROSS JOIN (VALUES (120), (200), (250), (300)) v(cutoff) GROUP BY 1, 2)
SELECT track_id, cutoff, R6(ls / ts) AS side_below, R6(lm / tm) AS mid_below, R6(10 * log10(ls / lm)) AS side_mid_below_db, R6(10 * log10((ts - ls) / (tm - lm))) AS side_mid_above_db FROM c""")
def low_frequency_cutoffs(spark, root):
    d = corpus.pooled(wb_dense(spark, root), K)
    # Upper edges of the coarse bands, and the cutoffs studied.
    hi = F.element_at(F.array(*[F.lit(x) for x in (120, 200, 250, 300, 2000, 10000, 1000000)]), F.col("band") + 1)
    d = d.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in (120, 200, 250, 300)])))
    g = d.groupBy("track_id", "cutoff").agg(
        F.sum("mid").alias("tm"), F.sum("side").alias("ts"), F.sum(F.when(hi <= F.col("cutoff"), F.col("mid")).otherwise(0.0)).alias("lm"),
        F.sum(F.when(hi <= F.col("cutoff"), F.col("side")).otherwise(0.0)).alias("ls"))
    return g.select(
        "track_id", "cutoff", rnd(F.when(F.col("ts") > 0, F.col("ls") / F.col("ts"))).alias("side_below"), rnd(F.when(F.col("tm") > 0, F.col("lm") / F.col("tm"))).alias("mid_below"),
        rnd(scalar.ratio_db(F.col("ls"), F.col("lm"))).alias("side_mid_below_db"), rnd(scalar.ratio_db(F.col("ts") - F.col("ls"), F.col("tm") - F.col("lm"))).alias("side_mid_above_db"))


@query("B5 C8 E11", "WITH" + DENSE_SQL + """,
v AS (SELECT cp.track_id, cp.band, p_ll, p_rr, p_lr, mid, side, CASE WHEN p_ll + p_rr = 0 THEN 'silence' WHEN p_ll = 0 THEN 'left_absent' WHEN p_rr = 0 THEN 'right_absent' WHEN side = 0 THEN 'dual_mono' WHEN mid = 0 THEN 'antiphase' ELSE 'stereo' END AS state
  FROM cp JOIN tt USING (track_id, win) WHERE total >= 1e-8 AND (p_ll + p_rr) / 2 >= greatest(1e-10, total * 1e-6)),
sc AS (SELECT track_id, band, string_agg(state || ':' || n, '|' ORDER BY state) AS states FROM (SELECT track_id, band, state, count(*) AS n FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT track_id, band, count(*) AS valid_windows, any_value(states) AS states, R6(10 * log10(avg(side) / avg(mid))) AS pooled_side_mid_db,
  R6(quantile_cont(CASE WHEN mid > 0 AND side > 0 THEN 10 * log10(side / mid) END, 0.1)) AS p10, R6(quantile_cont(CASE WHEN mid > 0 AND side > 0 THEN 10 * log10(side / mid) END, 0.5)) AS p50, R6(quantile_cont(CASE WHEN mid > 0 AND side > 0 THEN 10 * log10(side / mid) END, 0.9)) AS p90
FROM v JOIN sc USING (track_id, band) GROUP BY 1, 2""")
def band_summary(spark, root):
    d = wb_dense(spark, root)
    totals = d.groupBy("track_id", "win").agg(F.sum((F.col("p_ll") + F.col("p_rr")) / 2).alias("total")).where("total >= 1e-8")
    power = corpus.component("stereo")
    v = d.join(totals, ["track_id", "win"]).where(power >= F.greatest(F.lit(1e-10), F.col("total") * 1e-6))
    args = F.col("p_ll"), F.col("p_rr"), F.col("p_lr")
    v = v.select("track_id", "band", *args, scalar.stereo_state(*args).alias("state"), scalar.ratio_db(scalar.side_power(*args), scalar.mid_power(*args)).alias("db"))
    states = v.groupBy("track_id", "band", "state").agg(F.count("*").alias("n")).groupBy("track_id", "band").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))
    v = materialise(v)
    g = v.groupBy("track_id", "band").agg(F.count("*").alias("valid_windows"), *[F.avg(c).alias(c) for c in ("p_ll", "p_rr", "p_lr")])
    g = g.join(quantiles.grouped(v, ["track_id", "band"], {f"p{p}": ("db", p / 100, "linear") for p in (10, 50, 90)}), ["track_id", "band"])
    text = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat_ws(":", e["key"], e["value"])), "|")
    return g.join(states, ["track_id", "band"]).select(
        "track_id", "band", "valid_windows", text.alias("states"), rnd(scalar.ratio_db(corpus.component("side"), corpus.component("mid"))).alias("pooled_side_mid_db"), *[rnd(c).alias(c) for c in ("p10", "p50", "p90")])


@query("C7 E12", "WITH" + DENSE_SQL + """,
f AS (SELECT track_id, win, band, (p_ll + p_rr) / 2 / total AS fr FROM db JOIN aw USING (track_id, win))
SELECT track_id, band, count(*) AS windows, R6(avg(fr)) AS mean_fraction, R6(quantile_cont(fr, 0.1)) AS p10, R6(quantile_cont(fr, 0.5)) AS p50, R6(quantile_cont(fr, 0.9)) AS p90 FROM f GROUP BY 1, 2""")
def tonal_shape(spark, root):
    d = wb_dense(spark, root)
    f = d.join(corpus.active_windows(d, K), ["track_id", "win"]).select("track_id", "band", (corpus.component("stereo") / F.col("total")).alias("fr"))
    f = materialise(f)
    g = f.groupBy("track_id", "band").agg(F.count("*").alias("windows"), rnd(F.avg("fr")).alias("mean_fraction"))
    q = quantiles.grouped(f, ["track_id", "band"], {f"p{p}": ("fr", p / 100, "linear") for p in (10, 50, 90)})
    return g.join(q, ["track_id", "band"]).select("track_id", "band", "windows", "mean_fraction", *[rnd(c).alias(c) for c in ("p10", "p50", "p90")])


@query("C8 E12", "WITH" + DENSE_SQL + """,
s AS (SELECT cp.track_id, cp.win, band, total, unnest(['stereo', 'left', 'right', 'mid', 'side']) AS component, unnest([(p_ll + p_rr) / 2, p_ll, p_rr, mid, side]) AS v FROM cp JOIN aw ON aw.track_id = cp.track_id AND aw.win = cp.win),
t AS (SELECT track_id, component, sum(v) AS tv FROM s GROUP BY 1, 2)
SELECT s.track_id, band, s.component, R6(CASE WHEN tv > 0 THEN sum(v) / tv END) AS pooled_fraction, R6(avg(CASE WHEN v >= greatest(1e-10, total * 1e-6) THEN 1 ELSE 0 END)) AS reliable FROM s JOIN t ON t.track_id = s.track_id AND t.component = s.component GROUP BY s.track_id, band, s.component, tv""")
def band_reliability(spark, root):
    d = wb_dense(spark, root)
    d = d.join(corpus.active_windows(d, K), ["track_id", "win"]).select("track_id", "band", "total", *[corpus.component(c).alias(c) for c in corpus.COMPONENTS])
    s = d.unpivot(["track_id", "band", "total"], list(corpus.COMPONENTS), "component", "v")
    ok = (F.col("v") >= F.greatest(F.lit(1e-10), F.col("total") * 1e-6)).cast("double")
    g = s.groupBy("track_id", "band", "component").agg(F.sum("v").alias("v"), F.avg(ok).alias("reliable"))
    t = g.groupBy("track_id", "component").agg(F.sum("v").alias("tv"))
    return g.join(t, ["track_id", "component"]).select(
        "track_id", "band", "component", rnd(F.when(F.col("tv") > 0, F.col("v") / F.col("tv"))).alias("pooled_fraction"), rnd("reliable").alias("reliable"))


@query("E13", "WITH" + EV_SQL + """,
ext AS (SELECT track_id, max(frame) + 1 AS frames, max(greatest(abs(l), abs(r))) AS peak, sum((l * l + r * r) / 2) / (max(frame) + 1) AS power FROM ev GROUP BY 1),
sp AS (SELECT track_id, unnest(range(0, CASE WHEN frames >= 1440 THEN (frames - 1440) // 720 + 1 ELSE 0 END)) AS win FROM ext),
w AS (SELECT sp.track_id, win, sum((l * l + r * r) / 2) / 1440 AS p FROM sp JOIN ev ON ev.track_id = sp.track_id AND frame >= win * 720 AND frame < win * 720 + 1440 GROUP BY 1, 2)
SELECT track_id, R6(10 * log10(quantile_cont(p, 0.9)) - 10 * log10(quantile_cont(p, 0.1))) AS range_db, R6(10 * log10(any_value(peak * peak / power))) AS crest_db FROM w JOIN ext USING (track_id) WHERE p >= 1e-8 GROUP BY 1""")
def dynamics(spark, root):
    ev = event_samples(spark, root)
    w = cells.overlapping_windows(ev, K, "frame", 1440, 720, lr_sums()).where("NOT partial").withColumn("p", (F.col("ll") + F.col("rr")) / 2 / 1440).where("p >= 1e-8")
    full = ev.groupBy("track_id").agg(
        F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"), (F.sum((F.col("l") ** 2 + F.col("r") ** 2) / 2) / (F.max("frame") + 1)).alias("power"))
    q = quantiles.grouped(materialise(w.select("track_id", "p")), K, {"_hi": ("p", 0.9, "linear"), "_lo": ("p", 0.1, "linear")})
    g = q.select("track_id", (10 * F.log10("_hi") - 10 * F.log10("_lo")).alias("range_db"))
    return g.join(full, "track_id").select("track_id", rnd("range_db").alias("range_db"), rnd(scalar.ratio_db(F.col("peak") ** 2, F.col("power"))).alias("crest_db"))


# --- captures, groups, profiles -----------------------------------------------------

def captures(spark, root):
    """Orders as capture attempts of their customer's recording, line items as the timeline."""
    o, li, c = table(spark, root, "orders"), table(spark, root, "lineitem"), table(spark, root, "customer")
    expected = 80 + F.col("o_totalprice") / 1000
    li = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_discount", "l_tax", "l_quantity"))).alias("lines"))  # at most seven
    d = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey).withColumn("d", expected)
    frames = F.floor(F.col("d") * 48000)
    elapsed = frames / 48000
    tl = F.transform("lines", lambda x: F.struct(
        ((x["l_returnflag"] == "R") & (x["l_discount"] >= 0.1)).alias("ad"), F.lit(1.0).alias("rate"),
        F.when(x["l_tax"] >= 0.08, 0.6).otherwise(0.5).alias("volume"), F.col("d").alias("duration"), (x["l_linenumber"] * 8.0).alias("elapsed"),
        ((x["l_linenumber"] * 8 + F.when(x["l_quantity"] >= 49, 1).otherwise(0)) * 48000).cast("bigint").alias("capturedFrames")))
    cid = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("u"), cid)
    quiet = F.lit(False)
    prov = F.struct(
        F.when(F.col("o_orderstatus") == "P", "partial").otherwise("candidate").alias("quality"),
        F.struct(cid.alias("id"), F.when(F.col("o_totalprice") > 450000, "other").otherwise(url).alias("url")).alias("job"), quiet.alias("routeTailTest"),
        F.lit(True).alias("sourceMuted"), F.lit(True).alias("receiverMuted"), F.lit(True).alias("sourceMutedAfterCaptureStop"), quiet.alias("pcmPersisted"),
        F.struct(F.lit("none").alias("sink"), F.lit(2).alias("channels"), F.lit(48000).alias("rate"),
                 F.struct(quiet.alias("autoGainControl"), quiet.alias("echoCancellation"), quiet.alias("noiseSuppression")).alias("settings")).alias("capture"),
        F.col("d").alias("expectedDuration"), elapsed.alias("capturedDuration"), F.struct((F.col("d") - 0.1).alias("time")).alias("endBoundary"), F.lit(None).cast("double").alias("tailGuardSeconds"),
        F.array(F.struct(F.when(F.col("o_orderpriority") == "2-HIGH", 96000).otherwise(0).cast("bigint").alias("startFrame"), F.lit(4800).cast("bigint").alias("frames"))).alias("inputGaps"), tl.alias("timeline"))
    meas = F.struct(
        F.lit(48000).alias("sample_rate"), frames.alias("frames"), elapsed.alias("duration_s"), F.array(F.col("o_totalprice") / 1e6, F.lit(0.0)).alias("sample_peak_lr"),
        F.struct(F.col("o_totalprice").alias("mid_power"), F.col("o_totalprice").alias("side_power")).alias("full_file"), F.lit(5).alias("long_windows"))
    sett = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "on").otherwise("off").alias("stableVolume"),
                    F.array(F.struct(F.lit("false").alias("checked"), F.lit("Stable volume").alias("text"))).alias("menuAfter"))
    ev = F.array().cast("array<struct<kind:string,seconds:double,frames:bigint>>")
    return d.select("o_orderkey", "o_custkey", "o_orderdate", F.struct(cid.alias("id"), url.alias("url")).alias("job"), prov.alias("provenance"), meas.alias("measurement"), sett.alias("settings"), ev.alias("events"))


QC_SQL = """WITH ln AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R' AND l_discount >= 0.1) AS ad, max(CASE WHEN l_tax >= 0.08 THEN 0.6 ELSE 0.5 END) - min(CASE WHEN l_tax >= 0.08 THEN 0.6 ELSE 0.5 END) AS dv,
   count(*) FILTER (l_linenumber * 8 > 10) AS clocks, count(*) FILTER (l_linenumber * 8 > 10 AND l_quantity >= 49) AS drift FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey, o_custkey, coalesce(clocks, 0) AS clocks, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'capture_not_candidate' END, CASE WHEN o_totalprice > 450000 THEN 'source_url_mismatch' END,
   CASE WHEN 80 + o_totalprice / 1000 < 90 THEN 'invalid_content_duration' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'missing_interior_audio_input' END, CASE WHEN n IS NULL THEN 'missing_timeline' END, CASE WHEN ad THEN 'advertising_contamination' END,
   CASE WHEN n IS NULL THEN 'missing_player_gain' END, CASE WHEN dv > 0 THEN 'player_gain_changed' END, CASE WHEN drift > 0 THEN 'sample_clock_drift' END, CASE WHEN coalesce(clocks, 0) = 0 THEN 'no_clock_evidence' END,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'dynamic_platform_gain_unverified' END], lambda v: v IS NOT NULL) AS errors
  FROM orders LEFT JOIN ln ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"""


@query("C10", QC_SQL + " SELECT o_orderkey, array_to_string(errors, '|') AS errors, len(errors) = 0 AS accepted, CASE WHEN clocks > 0 THEN 'per_second' ELSE 'missing' END AS clock_evidence FROM a")
def qc_errors(spark, root):
    return capture.audit(captures(spark, root)).select("o_orderkey", F.array_join("errors", "|").alias("errors"), "accepted", "clock_evidence")


@query("G1 H1", QC_SQL + """ SELECT c_custkey, count(o_orderkey) AS attempts, CAST(count(*) FILTER (len(errors) = 0) AS BIGINT) AS accepted_attempts, min(o_orderkey) FILTER (len(errors) = 0) AS best, coalesce(bool_or(len(errors) = 0), FALSE) AS accepted
FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY 1""")
def best_attempt(spark, root):
    a = capture.audit(captures(spark, root)).select("o_custkey", "o_orderkey", "accepted", "clock_evidence")
    best = capture.best_attempts(a, "o_custkey", "o_orderkey")
    zero = F.lit(0).cast("bigint")
    return table(spark, root, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("attempts", zero).alias("attempts"), F.coalesce("accepted_attempts", zero).alias("accepted_attempts"), "best", F.col("best").isNotNull().alias("accepted"))


REC_SQL = """WITH rec AS (SELECT c_custkey, r_name AS genre, c_mktsegment AS artist, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS m, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS s, count(o_orderkey) AS orders, sum(o_totalprice) / 1000 AS seconds
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
rc AS (SELECT *, CASE WHEN m > 0 AND s > 0 THEN 10 * log10(s / m) END AS db, CASE WHEN coalesce(m, 0) + coalesce(s, 0) > 0 THEN coalesce(s, 0) / (coalesce(m, 0) + coalesce(s, 0)) END AS share, orders > 0 AS accepted FROM rec)"""


def recordings(spark, root):
    """Customers as recordings: region is the genre, finished and open orders are mid and side power."""
    dims = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("genre"))
    price, st = F.col("o_totalprice"), F.col("o_orderstatus")
    o = table(spark, root, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(st == "F", price)).alias("m"), F.sum(F.when(st == "O", price)).alias("s"), F.count("*").alias("orders"), (F.sum(price) / 1000).alias("seconds"))
    c = table(spark, root, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    d = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    m, s = F.coalesce("m", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return d.select(
        "c_custkey", "genre", F.col("c_mktsegment").alias("artist"), m.alias("m"), s.alias("s"), "seconds",
        scalar.ratio_db(s, m).alias("db"), scalar.energy_share(m, s).alias("share"), (F.coalesce("orders", F.lit(0)) > 0).alias("accepted"))


SUMMARY_SQL = """ SELECT genre, count(*) AS expected, CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, bool_and(accepted) AND count(*) >= 5 AS coverage_complete, count(db) AS n, R6(avg(db)) AS mean, R6(min(db)) AS min, R6(max(db)) AS max,
  R6(quantile_cont(db, 0.1)) AS p10, R6(quantile_cont(db, 0.5)) AS p50, R6(quantile_cont(db, 0.9)) AS p90 FROM rc GROUP BY 1"""


def summary(spark, root):
    d = corpus.group_summary(materialise(recordings(spark, root)), "genre", "db")
    return d.select("genre", "expected", "accepted", "coverage_complete", "n", *[rnd(c).alias(c) for c in ("mean", "min", "max", "p10", "p50", "p90")])


@query("E20 M3", REC_SQL + SUMMARY_SQL)
def group_summary(spark, root):
    return summary(spark, root)


@query("E21 M3", REC_SQL + """ SELECT genre, count(share) AS "references", R9(avg(share)) AS target_side, R9(min(share)) AS minimum_side, R9(max(share)) AS maximum_side, CAST(count(*) FILTER (m > 0 AND s > 0 AND abs(10 * log10(share / (1 - share)) - db) > 1e-9) AS BIGINT) AS inconsistent FROM rc GROUP BY 1""")
def genre_profile(spark, root):
    r = recordings(spark, root)
    odd = (F.col("m") > 0) & (F.col("s") > 0) & (F.abs(10 * F.log10(F.col("share") / (1 - F.col("share"))) - F.col("db")) > 1e-9)
    check = r.groupBy("genre").agg(F.sum(odd.cast("bigint")).alias("inconsistent"))
    p = corpus.genre_profile(r, "genre", "share")
    return check.join(p, "genre").select("genre", "references", *[rnd(c, 9).alias(c) for c in ("target_side", "minimum_side", "maximum_side")], "inconsistent")


@query("M7", REC_SQL + """, p AS (SELECT genre, avg(share) AS target FROM rc GROUP BY 1)
SELECT c_custkey, rc.genre, R6(share) AS share, R6(10 * log10(share / (1 - share)) - 10 * log10(target / (1 - target))) AS deviation_db FROM rc JOIN p ON p.genre = rc.genre WHERE share > 0 AND share < 1 AND abs(10 * log10(share / (1 - share)) - 10 * log10(target / (1 - target))) > 3""")
def profile_deviation(spark, root):
    """Recordings whose side/mid balance is more than 3 dB off their genre's profile."""
    r = recordings(spark, root)
    p = corpus.genre_profile(r, "genre", "share").select("genre", "target_side")

    def db(x):
        return 10 * F.log10(x / (1 - x))

    d = r.join(p, "genre").where("share > 0 AND share < 1").withColumn("deviation_db", db(F.col("share")) - db(F.col("target_side")))
    return d.where(F.abs("deviation_db") > 3).select("c_custkey", "genre", rnd("share").alias("share"), rnd("deviation_db").alias("deviation_db"))


@query("E22", REC_SQL + """ SELECT artist, CASE WHEN accepted THEN 'clean' ELSE 'quarantined' END AS quality, count(*) AS recordings, R3(coalesce(sum(seconds), 0)) AS seconds, R6(max(abs(db))) AS max_abs_db FROM rc GROUP BY 1, 2""")
def pilot_inventory(spark, root):
    return recordings(spark, root).groupBy("artist", F.when(F.col("accepted"), "clean").otherwise("quarantined").alias("quality")).agg(
        F.count("*").alias("recordings"), rnd(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"), rnd(F.max(F.abs("db"))).alias("max_abs_db"))


@query("G13", "WITH" + WB_SQL + """,
a AS (SELECT track_id, 10 * log10(sum((p_ll + p_rr - 2 * p_lr) / 4) / sum((p_ll + p_rr + 2 * p_lr) / 4)) AS db FROM wb GROUP BY 1),
b AS (SELECT track_id, 10 * log10(sum(pow((l - r) / 2, 2)) / sum(pow((l + r) / 2, 2))) AS db FROM li GROUP BY 1)
SELECT coalesce(a.track_id, b.track_id) AS track_id, R6(a.db) AS spectral_db, R6(b.db) AS direct_db, coalesce(abs(a.db - b.db) <= 1e-5, FALSE) AS agrees FROM a FULL JOIN b ON a.track_id = b.track_id""")
def cross_tool_check(spark, root):
    from soundgrid.queries.levels import track_sums
    from soundgrid.sources.views import line_samples

    a = window_bands(spark, root).groupBy("track_id").agg(*[F.sum(c).alias(c) for c in ("p_ll", "p_rr", "p_lr")])
    a = a.select("track_id", scalar.ratio_db(corpus.component("side"), corpus.component("mid")).alias("a"))
    b = track_sums(line_samples(spark, root)).select("track_id", scalar.ratio_db(F.col("side"), F.col("mid")).alias("b"))
    return a.join(b, "track_id", "full").select("track_id", rnd("a").alias("spectral_db"), rnd("b").alias("direct_db"), F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-5, F.lit(False)).alias("agrees"))


@query("M4", REC_SQL + ", s AS (" + SUMMARY_SQL + """),
x AS (SELECT genre, count(db) AS n, R6(avg(db)) AS mean FROM rc GROUP BY 1), y AS (SELECT genre, n, mean FROM s)
SELECT (SELECT count(*) FROM x) AS rows_a, (SELECT count(*) FROM y) AS rows_b, (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS only_a, (SELECT count(*) FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) AS only_b""")
def verify_except(spark, root):
    """Recompute the group table on another route and compare both ways."""
    r = recordings(spark, root)
    again = r.groupBy("genre").agg(F.count("db").alias("n"), rnd(F.sum("db") / F.count("db")).alias("mean"))
    return corpus.difference_counts(materialise(again), materialise(summary(spark, root).select("genre", "n", "mean")))


@query("G2", r"""WITH p AS (SELECT page_id, CAST(nullif(regexp_extract(url, '/(\d+)', 1), '') AS BIGINT) AS item, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS context FROM pages),
m AS (SELECT item, host, count(*) AS links, max(length(context)) AS longest FROM p WHERE item IS NOT NULL GROUP BY 1, 2),
b AS (SELECT m.item, m.host, links, min(page_id) AS page_id FROM m JOIN p ON p.item = m.item AND p.host = m.host AND length(p.context) = longest GROUP BY 1, 2, 3)
SELECT CAST(p_partkey AS BIGINT) AS job, b.host, links, b.page_id, p.context FROM part JOIN b ON b.item = p_partkey JOIN p ON p.page_id = b.page_id""")
def catalogue_evidence(spark, root):
    """For every job and host, the longest context of the links that name the job's item."""
    p = table(spark, root, "pages").select(
        "page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("item"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("context"))
    p = p.where("item <> ''").withColumn("item", F.col("item").cast("bigint"))
    best = p.groupBy("item", "host").agg(
        F.count("*").alias("links"), F.max_by(F.struct("page_id", "context"), F.struct(F.length("context"), -F.col("page_id"))).alias("b"))
    jobs = table(spark, root, "part").select(F.col("p_partkey").alias("job"))
    return jobs.join(best, F.col("job") == F.col("item")).select("job", "host", "links", "b.page_id", "b.context")


@query("I1", """SELECT root, item, min(pos) AS first_pos FROM (SELECT 'orders' AS root, o_custkey AS item, o_orderkey AS pos FROM orders UNION ALL SELECT 'customers', c_custkey, -1 FROM customer) GROUP BY 1, 2""")
def attempt_roots(spark, root):
    """Union of attempt lists, de-duplicated with the first position kept."""
    a = table(spark, root, "orders").select(F.lit("orders").alias("root"), F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("pos"))
    b = table(spark, root, "customer").select(F.lit("customers").alias("root"), F.col("c_custkey").alias("item"), F.lit(-1).cast("bigint").alias("pos"))
    return a.unionByName(b).groupBy("root", "item").agg(F.min("pos").alias("first_pos"))


@query("A8")
def study_archive(spark, root):
    """Audio-free archive rows: payload, its hash, and the recording it describes."""
    r = recordings(spark, root)
    payload = F.to_json(F.struct("c_custkey", "genre", "artist", "m", "s", "db", "share", "accepted"))
    return r.select("c_custkey", "genre", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))
