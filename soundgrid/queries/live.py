"""Streaming queries, drained over the tables' files."""
from __future__ import annotations

from pyspark.sql import functions as F

from soundgrid.functions import scalar
from soundgrid.queries.levels import K, TIMELINE_SQL, WIN_SQL
from soundgrid.queries.registry import query, rnd
from soundgrid.queries.spans import TRUE_PEAK_SQL
from soundgrid.sources.views import HOP, RATE, pan
from soundgrid.streaming import streams


def stream_samples(spark, root):
    return pan(streams.read_table(spark, root, "events"))


def energy():
    l, r = F.col("l"), F.col("r")
    return {"energy": F.sum(l * l + r * r)}


@query("K1", "WITH" + TIMELINE_SQL + " SELECT track_id, hop AS win, R6(m_lufs) AS lufs FROM lv WHERE m_lufs IS NOT NULL")
def stream_loudness(spark, root):
    s = streams.drain(streams.sliding_sums(stream_samples(spark, root), K, RATE, 4 * HOP, HOP, energy()), [*K, "win"])
    n = streams.drain(streams.lengths(stream_samples(spark, root), K), K)
    return streams.incremental_loudness(s, n, K, 4 * HOP, HOP).where("lufs IS NOT NULL").select("track_id", "win", rnd("lufs").alias("lufs"))


@query("K2", "WITH" + TRUE_PEAK_SQL + " SELECT track_id, lastf + 1 AS frames, R9(true_peak) AS true_peak FROM tp JOIN la USING (track_id)")
def stream_true_peak(spark, root):
    d = streams.true_peak(stream_samples(spark, root).select("track_id", "frame", "l", "r"), "track_id")
    return d.withColumn("true_peak", rnd("true_peak", 9))


@query("K3")
def stream_spectrum(spark, root):
    hz = [20 * 90 ** (i / 63) for i in range(64)]
    return streams.drain(streams.live_spectrum(stream_samples(spark, root).select("track_id", "frame", "l", "r"), "track_id", RATE, 1024, hz), K)


@query("K4", "WITH" + WIN_SQL + """ SELECT track_id, win, start, "end", "partial", R6(10 * log10(ll + rr)) AS level_db FROM wm WHERE ll + rr > 0""")
def stream_windows(spark, root):
    s = streams.drain(streams.sliding_sums(stream_samples(spark, root), K, RATE, 3 * RATE, 3 * RATE // 2, energy()), [*K, "win"])
    n = streams.drain(streams.lengths(stream_samples(spark, root), K), K)
    d = streams.windows_with_tail(s, n, K, 3 * RATE, 3 * RATE // 2, ["energy"]).where("energy > 0")
    return d.select("track_id", "win", "start", "end", "partial", rnd(10 * F.log10(F.col("energy") / (F.col("end") - F.col("start")))).alias("level_db"))


@query("K5", """SELECT l_orderkey, l_linenumber, l_linenumber * 8.0 AS elapsed, l_linenumber * 8.0 + CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END AS captured FROM lineitem WHERE l_linenumber * 8 > 10 AND l_quantity >= 49""".replace("8.0", "8.0::DOUBLE"))
def stream_clock_drift(spark, root):
    li = streams.read_table(spark, root, "lineitem")
    elapsed = F.col("l_linenumber") * 8.0
    p = li.select("l_orderkey", "l_linenumber", elapsed.alias("elapsed"), (elapsed + F.when(F.col("l_quantity") >= 49, 1.0).otherwise(0.0)).alias("captured"))
    return streams.drain(streams.clock_drift(p), [], "append")
