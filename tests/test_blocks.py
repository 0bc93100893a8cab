"""Blocked windows, ranks and joins against brute force."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from soundgrid.functions import quantiles
from soundgrid.operators import blocks, intervals, joins, windows

K = ["k"]


def series(seed=1, n=300, keys=3, span=900):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        for p in np.sort(rng.choice(span, n // (k + 1), replace=False)):
            rows.append((k, int(p), float(rng.integers(0, 40))))
    return pd.DataFrame(rows, columns=["k", "pos", "v"])


def test_halo_equals_plain_frames(spark):
    pdf = series()
    h = blocks.halo(spark.createDataFrame(pdf), K, "pos", 7, 4, block=16)
    got = h.with_columns({"s": F.sum("v").over(h.reach(7, 4)), "m": F.max("v").over(h.reach(7, 4))}).own().toPandas()
    assert len(got) == len(pdf)
    for r in got.itertuples():
        near = pdf[(pdf.k == r.k) & (pdf.pos >= r.pos - 7) & (pdf.pos <= r.pos + 4)]
        assert r.s == near.v.sum() and r.m == near.v.max()


def test_running_folds(spark):
    pdf = series(2)
    d = spark.createDataFrame(pdf)
    got = blocks.running(d, K, "pos", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block=10).toPandas().sort_values(["k", "pos"])
    want = pdf.sort_values(["k", "pos"]).groupby("k").v
    assert np.allclose(got.s, want.cumsum()) and np.allclose(got.m, want.cummax())
    back = blocks.running(d, K, "pos", {"m": ("min", F.col("v"))}, before_only=True, forward=False, block=10).toPandas().sort_values(["k", "pos"])
    rev = pdf.sort_values(["k", "pos"], ascending=[True, False]).groupby("k").v.transform(lambda x: x.cummin().shift())
    assert np.allclose(back.m.to_numpy(), rev.sort_index().to_numpy(), equal_nan=True)


def test_previous_row_and_nearest_mark(spark):
    pdf = series(3)
    got = blocks.previous_row(spark.createDataFrame(pdf), K, "pos", {"p": "v"}, block=10).toPandas().sort_values(["k", "pos"])
    assert np.allclose(got.p.to_numpy(), pdf.groupby("k").v.shift().to_numpy(), equal_nan=True)
    marks = pdf[pdf.v > 30].rename(columns={"pos": "at"})[["k", "at"]]
    marks["name"] = marks["at"]
    a = joins.asof(spark.createDataFrame(pdf), spark.createDataFrame(marks), K, "pos", "at", "name", "b", "a", block=20).toPandas()
    for r in a.itertuples():
        at = marks[marks.k == r.k]["at"]
        before, after = at[at <= r.pos], at[at >= r.pos]
        assert (before.max() if len(before) else None) == (None if pd.isna(r.b) else r.b)
        assert (after.min() if len(after) else None) == (None if pd.isna(r.a) else r.a)


def test_quantile_conventions(spark):
    rng = np.random.default_rng(4)
    rows = [(n, float(v)) for n in range(1, 40) for v in rng.integers(0, 25, n)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["n", "v"]))
    got = d.groupBy("n").agg(
        quantiles.lower("v", 0.9).alias("lo"), quantiles.lower_median("v").alias("lm"), quantiles.floor_rank("v", 0.9).alias("fr"),
        quantiles.upper_median("v").alias("um"), quantiles.linear("v", 0.95).alias("li")).collect()
    for r in got:
        s = np.sort([v for n, v in rows if n == r.n])
        assert r.lo == s[int(np.ceil(0.9 * r.n - 1e-12)) - 1] and r.lm == s[(r.n - 1) // 2] and r.um == s[r.n // 2]
        assert r.fr == s[int((r.n - 1) * 0.9)] and abs(r.li - np.percentile(s, 95)) < 1e-12


def test_order_statistics_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.where(rng.random(30000) < 0.8, 0, rng.integers(1, 40, 30000)), "v": np.round(rng.lognormal(0, 2, 30000), 2)})
    got = quantiles.order_statistics(spark.createDataFrame(pdf), K, "v", {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9}).toPandas()
    assert len(got) == pdf.k.nunique()
    for r in got.itertuples():
        v = pdf[pdf.k == r.k].v
        assert r.n == len(v)
        assert np.allclose([r.p0, r.p10, r.p50, r.p90], np.percentile(v, [0, 10, 50, 90]), rtol=1e-12)


def test_grouped_quantiles_beyond_the_limit(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": rng.choice(4, 9000, p=[0.7, 0.2, 0.09, 0.01]), "v": np.round(rng.normal(0, 5, 9000), 1)})
    specs = {m: ("v", 0.3, m) for m in quantiles.RANKS} | {"um": ("v", 0.5, "upper")}
    d = spark.createDataFrame(pdf)
    a = quantiles.grouped(d, K, specs).toPandas().sort_values("k")
    b = quantiles.grouped(d, K, specs, limit=10).toPandas().sort_values("k")
    for m in specs:
        assert np.allclose(a[m], b[m]), m
    s = np.sort(pdf[pdf.k == 0].v)
    assert a.um.iloc[0] == s[len(s) // 2] and a.nearest.iloc[0] == s[int((len(s) - 1) * 0.3 + 0.5)]


def test_greedy_gap(spark):
    pdf = series(6)[["k", "pos"]]
    got = windows.greedy_gap(spark.createDataFrame(pdf), K, "pos", 9).toPandas()
    for k, g in pdf.groupby("k"):
        kept, last = [], -10**9
        for p in g.pos:
            if p - last >= 9:
                kept.append(p)
                last = p
        assert sorted(got[got.k == k].pos) == kept


def test_forward_min_narrow_and_wide(spark):
    v = np.random.default_rng(7).random(700)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "pos": np.arange(700), "v": v}))
    for look in (5, 150):
        got = windows.forward_min(d, K, "pos", "v", look, "m").toPandas().sort_values("pos")
        assert np.allclose(got.m, [v[i:i + look + 1].min() for i in range(700)])


def test_slew_and_triangle(spark):
    rng = np.random.default_rng(8)
    v = -rng.random(120) * (rng.random(120) < 0.2) * 5
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "pos": np.arange(120), "v": v, "top": 119}))
    got = windows.slew_limit(d, K, "pos", "v", 0.1, 0.3, "g").toPandas().sort_values("pos")
    g = v.copy()
    for i in range(1, 120):
        g[i] = min(g[i], g[i - 1] + 0.1)
    for i in range(118, -1, -1):
        g[i] = min(g[i], g[i + 1] + 0.3)
    assert np.allclose(got.g, g)
    t = windows.triangular(d, K, "pos", "top", "v", 4, "t").toPandas().sort_values("pos")
    w = 5 - np.abs(np.arange(-4, 5))
    want = [sum(w[j + 4] * v[min(119, max(0, i + j))] for j in range(-4, 5)) / w.sum() for i in range(120)]
    assert np.allclose(t.t, want)


def test_intervals(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(s), int(s + rng.integers(1, 25))) for k in range(3) for s in rng.integers(0, 600, 60)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "start", "end"]))
    merged = intervals.merge(d, K, block=40).toPandas()
    for k in range(3):
        cover = np.zeros(700, bool)
        for kk, s, e in rows:
            if kk == k:
                cover[s:e] = True
        edge = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        want = sorted(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        assert sorted(zip(merged[merged.k == k].start, merged[merged.k == k].end)) == want
    pts = pd.DataFrame({"k": 0, "pos": np.arange(700)})
    m = merged[merged.k == 0]
    got = intervals.exclusion_weight(spark.createDataFrame(pts), spark.createDataFrame(m), K, "pos", 20.0, 3.0, "w").toPandas().sort_values("pos")
    for p, w in zip(got.pos, got.w):
        if ((m.start <= p) & (p < m.end)).any():
            assert w == 0
        else:
            dist = min([s - p for s in m.start if s > p] + [p - e for e in m.end if e <= p])
            t = min(1, max(0, (dist - 3) / 20))
            assert abs(w - t * t * (3 - 2 * t)) < 1e-12


def test_overlap_resample(spark):
    v = np.random.default_rng(10).random(45)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "pos": np.arange(45), "v": v, "n": 45}))
    got = joins.overlap_resample(d, K, "pos", F.col("n"), "v", 32).toPandas().sort_values("bin")
    fine = np.repeat(v, 32).reshape(32, 45).mean(1)
    assert np.allclose(got.value, fine)


def test_spread_bounds_the_rows_of_a_task(spark):
    d = blocks.halo(spark.range(3_000_000).selectExpr("id div 500 AS track_id", "id % 500 AS cell"), ["track_id"], "cell", 3, 3).spread(3_000_000)
    own = d.with_columns({"_n": F.count("*").over(d.reach(3, 3))}).own()
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000_000 and max(sizes) < 1.5 * blocks.TASK_ROWS
