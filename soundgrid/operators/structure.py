"""Structural features of a track and the boundaries found in them.

A track is described by 0.5 s cells: twelve chroma values, eight shape values,
flux and activity. Everything works on that reduced table, in blocks along time.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.functions import quantiles, scalar
from soundgrid.operators import kernels
from soundgrid.operators.blocks import halo
from soundgrid.operators.windows import local_maxima, robust_scale
from soundgrid.session import materialise

NC, NS = 12, 8
RADII = (4, 8, 16)          # 2, 4 and 8 seconds
SEPARATION = 4
MOMENTARY_HOPS = 4
MAX_BOUNDARIES = 65
MAX_SEGMENTS = 64


def active_readings(hops: DataFrame, lengths: DataFrame, keys: list[str], hop: int, per: int) -> DataFrame:
    """Complete momentary readings above the absolute gate that start in each cell, from the hops' energy _e."""
    starts = hops.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOMENTARY_HOPS - 1)), lambda k: F.col("_hop") - k)).alias("_at"), "_e").where("_at >= 0")
    power = F.col("_e") / (MOMENTARY_HOPS * hop)
    loud = starts.groupBy(*keys, "_at").agg(F.sum("_e").alias("_e")).where(scalar.lufs(power) > scalar.ABSOLUTE_GATE_LUFS)
    whole = (F.col("_at") + MOMENTARY_HOPS) * hop <= F.col("frames")
    return loud.join(lengths, keys).where(whole).groupBy(*keys, F.expr(f"_at div {per}").alias("idx")).agg(F.count("*").alias("_on"))


def features(samples: DataFrame, keys: list[str], cell: int, hop: int, pitch: Column, band: Column, weight: Column) -> DataFrame:
    """Dense 0.5 s cells from samples that carry a pitch class, a shape band and a weight."""
    s = samples.select(*keys, "frame", pitch.alias("_p"), band.alias("_b"), weight.alias("_w"))
    sums = [F.sum(F.when(F.col("_p") == k, F.col("_w")).otherwise(0.0)).alias(f"_c{k}") for k in range(NC)]
    sums += [F.sum(F.when(F.col("_b") == k, F.col("_w")).otherwise(0.0)).alias(f"_s{k}") for k in range(NS)]
    hops = s.groupBy(*keys, F.expr(f"frame div {hop}").alias("_hop")).agg(*sums, F.sum("_w").alias("_e"))
    per = cell // hop
    names = [f"_c{k}" for k in range(NC)] + [f"_s{k}" for k in range(NS)]
    sparse = hops.groupBy(*keys, F.expr(f"_hop div {per}").alias("idx")).agg(*[F.sum(n).alias(n) for n in names])
    n = samples.groupBy(*keys).agg((F.max("frame") + 1).alias("frames"))
    spine = n.select(*keys, "frames", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(frames - 1) div {cell}"))).alias("idx"))
    loud = active_readings(hops, n, keys, hop, per)
    d = spine.join(sparse, [*keys, "idx"], "left").join(loud, [*keys, "idx"], "left").fillna(0.0, names).fillna(0, ["_on"])
    complete = F.least(F.lit(per), F.floor((F.col("frames") - MOMENTARY_HOPS * hop) / hop) + 1 - F.col("idx") * per)
    # Written out per component: expressions over columns are compiled, functions over arrays are not.
    chroma, shape = [F.col(f"_c{k}") for k in range(NC)], [F.log1p(f"_s{k}") for k in range(NS)]
    d = d.select(
        *keys, "idx", "frames", *chroma, *[c.alias(f"_s{k}") for k, c in enumerate(shape)],
        F.sqrt(_total(chroma)).alias("_m"), F.sort_array(F.array(*chroma))[1].alias("_low"), (_total(shape) / NS).alias("_mean"),
        F.when(complete > 0, F.col("_on") / complete).otherwise(0.0).alias("activity"))
    h = halo(d, keys, "idx", 1, 0)
    rise = F.greatest(F.lit(0.0), F.col("_m") - F.coalesce(F.max("_m").over(h.window.rangeBetween(-1, -1)), F.lit(0.0)))
    d = h.with_columns({"flux": rise}).own()
    d = d.withColumns({f"_c{k}": F.greatest(F.lit(0.0), F.col(f"_c{k}") - F.col("_low")) for k in range(NC)} | {f"_s{k}": F.col(f"_s{k}") - F.col("_mean") for k in range(NS)})
    return d.select(*keys, "idx", "frames", _unit([f"_c{k}" for k in range(NC)]).alias("chroma"), _unit([f"_s{k}" for k in range(NS)]).alias("shape"), "flux", "activity")


def _total(values: list[Column]) -> Column:
    return functools.reduce(lambda a, x: a + x, values, F.lit(0.0))


def _unit(names: list[str]) -> Column:
    """Columns as one array of norm one; as they are if all are near zero."""
    norm = F.sqrt(_total([F.col(n) * F.col(n) for n in names]))
    return F.array(*[F.when(norm > 1e-12, F.col(n) / norm).otherwise(F.col(n)) for n in names])


def cosine_distance(a: Column, b: Column, chroma: bool) -> Column:
    """0 for two empty vectors, 1 for one empty; chroma on [0, 1], shape halved."""

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    na, nb = norm(a), norm(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0 if chroma else -1.0), dot / (na * nb)))
    return F.when((na <= 1e-12) & (nb <= 1e-12), 0.0).when((na <= 1e-12) | (nb <= 1e-12), 1.0).otherwise(1 - c if chroma else (1 - c) / 2)


def raw_novelty(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of the medians before and after each boundary at three radii.

    `cells` has chroma, shape, activity, flux; boundary b lies before cell b. A task
    takes the blocks of its tracks in order, and numpy all blocks of an Arrow batch
    together; the last block of a batch waits for the next, as it may go on there.
    """
    far = max(RADII)
    vec = F.concat("chroma", "shape", F.array("activity", "flux"))
    h = halo(cells.select(*keys, "idx", vec.alias("v")), keys, "idx", far, far - 1)
    size, width = h.block, NC + NS + 2
    fields = [f for f in h.df.schema if f.name in keys or f.name == "idx"]
    schema = T.StructType(fields + [T.StructField("radius", T.IntegerType()), T.StructField("raw", T.DoubleType())])
    # The first row of a block, so that no key is compared in Python.
    w = Window.partitionBy(*keys, "_blk").orderBy("idx")
    d = h.df.repartition(*keys, "_blk").withColumn("_new", F.lag("idx").over(w).isNull()).sortWithinPartitions(*keys, "_blk", "idx")

    def scores(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = table.num_rows
        ends = np.append(starts[1:], rows)
        first, stop = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, width)
        idx = table["idx"].to_numpy()
        own = np.flatnonzero((idx // size == table["_blk"].to_numpy()) & (idx > 0))
        raw = np.concatenate([kernels.novelty_of_blocks(v, r, first, stop)[own] for r in RADII])
        kept = table.select([f.name for f in fields]).take(pa.array(np.tile(own, len(RADII))))
        radius = pa.array(np.repeat(np.array(RADII, np.int32), len(own)))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in kept.columns], radius, pa.array(raw, from_pandas=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if wait is None else pa.concat_tables([wait, table])
            starts = np.flatnonzero(table["_new"].to_numpy())
            if len(starts) > 1:
                yield scores(table.slice(0, starts[-1]), starts[:-1])
            wait = table.slice(starts[-1]) if len(starts) else table
        if wait is not None and wait.num_rows:
            yield scores(wait, np.zeros(1, np.int64))

    return d.mapInArrow(run, schema)


def _lower_middle(values: Column) -> Column:
    s = F.array_sort(values)
    return F.element_at(s, F.floor((F.size(s) - 1) / 2).cast("int") + 1)


def novelty(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the robustly scaled novelties of the three radii."""
    d = robust_scale(raw_novelty(cells, keys), [*keys, "radius"], "raw", "_z")
    return d.groupBy(*keys, "idx").agg((F.sum("_z") / len(RADII)).alias("novelty"))


def persistent_contrast(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Lasting change across a boundary: four windows of four cells, inner and outer contrast against the change within."""
    h = halo(cells.select(*keys, "idx", "chroma", "shape"), keys, "idx", 8, 7)
    spans = ((-8, -5), (-4, -1), (0, 3), (4, 7))
    cols = {"_n": F.count("*").over(h.reach(8, 7))}
    for i, (a, b) in enumerate(spans):
        w = h.window.rangeBetween(a, b)
        cols[f"_c{i}"] = F.array(*[F.avg(F.col("chroma")[k]).over(w) for k in range(NC)])
        cols[f"_s{i}"] = F.array(*[F.avg(F.col("shape")[k]).over(w) for k in range(NS)])
    d = h.with_columns(cols).own()

    def dist(i: int, j: int) -> Column:
        return 0.5 * cosine_distance(F.col(f"_c{i}"), F.col(f"_c{j}"), True) + 0.3 * cosine_distance(F.col(f"_s{i}"), F.col(f"_s{j}"), False)

    d = d.where("_n = 16").withColumns({"_in": dist(1, 2), "_out": dist(0, 3), "_w": F.greatest(dist(0, 1), dist(2, 3))})
    return d.select(*keys, "idx", F.greatest(F.lit(0.0), F.least("_in", "_out") - 4 * F.col("_w")).alias("contrast"))


def ramp_contrast(readings: DataFrame, keys: list[str], hops_per_cell: int, hop_seconds: float, span_cells: int = 8, window_hops: int = 30) -> DataFrame:
    """Start or end of a lasting loudness ramp, from the slopes of 4 s spans beside a boundary.

    `readings` has one short-term level per hop. A span's slope needs every one of
    its complete windows.
    """
    count = span_cells * hops_per_cell - window_hops + 1
    quarter = max(1, count // 4)
    h = halo(readings.select(*keys, "hop", "s_lufs"), keys, "hop", 0, count - 1)

    def low_median(a: int, b: int) -> Column:
        return _lower_middle(F.collect_list("s_lufs").over(h.window.rangeBetween(a, b)))

    ok = F.count("s_lufs").over(h.reach(0, count - 1)) == count
    slope = (low_median(count - quarter, count - 1) - low_median(0, quarter - 1)) / ((count - quarter) * hop_seconds)
    s = h.with_columns({"slope": F.when(ok, slope)}).own().where(F.col("hop") % hops_per_cell == 0).select(
        *keys, F.expr(f"hop div {hops_per_cell}").alias("idx"), "slope")
    g = halo(s, keys, "idx", 2 * span_cells, span_cells)

    def at(o: int) -> Column:
        return F.max("slope").over(g.window.rangeBetween(o, o))

    g = g.with_columns({"_before": at(-span_cells), "_later": at(span_cells), "_earlier": at(-2 * span_cells)})

    def ramp(still: Column, near: Column, far: Column) -> Column:
        bad = still.isNull() | near.isNull() | far.isNull() | (F.abs(still) >= 0.1) | (F.signum(near) != F.signum(far))
        return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.abs(near), F.abs(far)) - 4 * F.abs(still) - 4 * F.abs(near - far)))

    b, a, later, earlier = F.col("_before"), F.col("slope"), F.col("_later"), F.col("_earlier")
    return g.own().where("idx > 0").select(*keys, "idx", F.greatest(ramp(b, a, later), ramp(a, b, earlier)).alias("ramp"))


def candidates(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Local maxima within +-4 cells; of equal scores the earlier."""
    return local_maxima(scores, keys, "idx", score, SEPARATION).where(F.col("is_max") & (F.col(score) > 0)).select(*keys, "idx", score)


def suppress(cands: DataFrame, keys: list[str], score: str, limit: int = MAX_BOUNDARIES) -> DataFrame:
    """Greedy non-maximum suppression: by score, at least four cells apart, at most `limit`.

    Only a bounded number of best candidates can decide the picks; the rest never
    leave their map task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "idx")
    top = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit * (2 * SEPARATION - 1))
    a = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("idx").alias("i")))).alias("_a"))
    kept = F.aggregate(
        "_a", F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda y: F.abs(y - x["i"]) < SEPARATION), F.concat(acc, F.array(x["i"]))).otherwise(acc))
    return a.select(*keys, F.array_sort(kept).alias("boundaries"))


def thresholds(scores: DataFrame, keys: list[str], score: str, mad_times: float = 3.0) -> DataFrame:
    """The ladder of selection thresholds: median + 3 MAD (or P95), P97.5, P99."""
    m = quantiles.grouped(scores, keys, {
        "_med": (score, 0.5, "lower"), "_p95": (score, 0.95, "lower"), "t1": (score, 0.975, "lower"), "t2": (score, 0.99, "lower")})
    dev = materialise(scores.join(m, keys).select(*keys, F.abs(F.col(score) - F.col("_med")).alias("_d")))
    mad = quantiles.grouped(dev, keys, {"_mad": ("_d", 0.5, "lower")})
    return m.join(mad, keys).select(*keys, F.when(F.col("_mad") > 0, F.col("_med") + mad_times * F.col("_mad")).otherwise(F.col("_p95")).alias("t0"), "t1", "t2")


def ladder(scores: DataFrame, keys: list[str], score: str, limit: int = MAX_BOUNDARIES) -> DataFrame:
    """Boundaries for each rung as arrays b0, b1, b2 (one row per track)."""
    scores = materialise(scores)
    c = materialise(candidates(scores, keys, score))
    t = materialise(thresholds(scores, keys, score))
    rungs = t.select(*keys, F.posexplode(F.array("t0", "t1", "t2")).alias("_rung", "_t"))
    over = c.join(rungs, keys).where(F.col(score) > F.col("_t")).drop("_t")
    kept = suppress(over, [*keys, "_rung"], score, limit).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rung") == i, F.col("boundaries"))).alias(f"b{i}") for i in range(3)])
    return t.select(*keys).join(kept, keys, "left").withColumns(
        {f"b{i}": F.coalesce(f"b{i}", F.array().cast("array<bigint>")) for i in range(3)})
