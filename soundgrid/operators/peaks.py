"""Peaks: sample, true (inter-sample), per block, and ceilings planned from them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four-phase, twelve-tap interpolation filter of the published
# true-peak standard (one row per phase, newest sample first).
TRUE_PEAK_PHASES = (
    (0.001708984375, 0.010986328125, -0.0196533203125, 0.033203125, -0.0594482421875, 0.1373291015625,
     0.97216796875, -0.102294921875, 0.047607421875, -0.026611328125, 0.014892578125, -0.00830078125),
    (-0.0291748046875, 0.029296875, -0.0517578125, 0.089111328125, -0.16650390625, 0.465087890625,
     0.77978515625, -0.2003173828125, 0.1015625, -0.0582275390625, 0.0330810546875, -0.0189208984375),
    (-0.0189208984375, 0.0330810546875, -0.0582275390625, 0.1015625, -0.2003173828125, 0.77978515625,
     0.465087890625, -0.16650390625, 0.089111328125, -0.0517578125, 0.029296875, -0.0291748046875),
    (-0.00830078125, 0.014892578125, -0.026611328125, 0.047607421875, -0.102294921875, 0.97216796875,
     0.1373291015625, -0.0594482421875, 0.033203125, -0.0196533203125, 0.010986328125, 0.001708984375),
)
TAPS = 12
TAIL_FRAMES = 6


#: Frames of a track that one task orders at a time.
PEAK_BLOCK = 1 << 16
#: Interpolated values a task holds at once, about.
_AT_ONCE = 1 << 21

# Share of a sample in the output t frames after a sample that itself comes `gap` frames later: [gap, t, phase].
_SHARES = np.zeros((TAPS, TAPS, len(TRUE_PEAK_PHASES)))
for _gap in range(TAPS):
    _SHARES[_gap, : TAPS - _gap] = np.asarray(TRUE_PEAK_PHASES).T[_gap:]


def _interpolated(pos: np.ndarray, x: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Magnitudes of the outputs at and after the samples first .. stop - 1: [sample, frames after it, channel], largest phase.

    Only the samples up to this one count, so a value holds until the next sample.
    """
    y = np.zeros((stop - first, TAPS, len(TRUE_PEAK_PHASES), x.shape[1]))
    for k in range(TAPS):
        at = np.arange(max(first, k), stop)
        gap = pos[at] - pos[at - k]
        at, gap = at[gap < TAPS], gap[gap < TAPS]
        if not len(at):
            break
        y[at - first] += _SHARES[gap][..., None] * x[at - k][:, None, None, :]
    return np.abs(y, out=y).max(axis=2)


def true_peaks(samples: DataFrame, keys: list[str], frame: str, channels: list[str], factors: list[Column], by: list[str] | None = None, block: int = PEAK_BLOCK) -> DataFrame:
    """Sample and true peaks per key of the samples times each of the factors (arrays), with the six-frame tail at the end.

    The factors may use the columns `by`. Sounding frames are ordered in blocks of
    a track, and an output is interpolated at the latest sample that reaches it:
    silence costs nothing, no sample is copied per tap or factor between tasks, and
    a task holds a few thousand frames at a time. Only one row of peaks leaves a block.
    """
    size, n = len(channels), len(factors)
    merged = samples.groupBy(*keys, frame, *(by or [])).agg(*[F.sum(c).alias(c) for c in channels])
    reach = F.sequence(F.floor(F.col(frame) / block), F.floor((F.col(frame) + TAPS - 1) / block))
    d = merged.withColumn("_blk", F.explode(reach)).repartition(*keys, "_blk")
    some = F.greatest(*[F.col(c).isNotNull() for c in channels])
    d = d.groupBy(*keys, "_blk", frame).agg(
        F.array(*[F.coalesce(F.sum(F.col(c) * f), F.lit(0.0)) for f in factors for c in channels]).alias("_x"), F.max(some).alias("_some"))
    w = Window.partitionBy(*keys, "_blk").orderBy(frame)
    d = d.select(
        *keys, "_some", "_x", F.col(frame).cast("bigint").alias("_f"), F.col("_blk"), (F.col(frame) - F.lag(frame).over(w)).cast("bigint").alias("_gap"),
        (F.lead(frame).over(w) - F.col(frame)).cast("bigint").alias("_next")).sortWithinPartitions(*keys, "_blk", "_f")
    values = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[d.schema[k] for k in keys], T.StructField("_some", T.BooleanType()), T.StructField("_f", T.LongType()), *[T.StructField(c, values) for c in ("_s", "_i", "_e")]])

    def arrays(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) * n + 1, n), pa.int32()), pa.array(a.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, x = np.zeros(0, np.int64), np.zeros((0, size * n))
        t = np.arange(TAPS)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_f", "_blk", "_gap", "_next", "_x", "_some")}
            f, blk = column["_f"].to_numpy(), column["_blk"].to_numpy()
            starts = column["_gap"].is_null().to_numpy(zero_copy_only=False)
            gap = np.where(starts, TAPS, column["_gap"].fill_null(TAPS).to_numpy())
            last = column["_next"].is_null().to_numpy(zero_copy_only=False)
            until = column["_next"].fill_null(TAPS).to_numpy()
            own = column["_x"].flatten().to_numpy(zero_copy_only=False).reshape(rows, size * n)
            m = len(pos)
            pos, x = np.concatenate([pos, (pos[-1] if m else 0) + np.cumsum(gap)]), np.concatenate([x, own])
            low, high = blk * block - f, np.minimum((blk + 1) * block - f, until)
            inner, edge = np.zeros((rows, n)), np.zeros((rows, n))
            step = max(1, _AT_ONCE // (TAPS * len(TRUE_PEAK_PHASES) * size * n))
            for i in range(0, rows, step):
                j = min(rows, i + step)
                y = _interpolated(pos, x, m + i, m + j).reshape(j - i, TAPS, n, size).max(axis=3)
                there = (t >= low[i:j, None]) & (t < high[i:j, None])
                tail = last[i:j, None] & (t > TAIL_FRAMES)
                inner[i:j] = np.where((there & ~tail)[..., None], y, 0.0).max(axis=1)
                edge[i:j] = np.where((there & tail)[..., None], y, 0.0).max(axis=1)
            starts[0] = True
            at = np.flatnonzero(starts)
            ends = np.append(at[1:], rows) - 1
            peak = np.abs(own).reshape(rows, n, size).max(axis=2)
            heads = batch.take(pa.array(at))
            out = [heads.column(heads.schema.get_field_index(k)) for k in keys]
            out.append(pa.array(np.maximum.reduceat(column["_some"].to_numpy(zero_copy_only=False), at)))
            out += [pa.array(f[ends]), *[arrays(np.maximum.reduceat(a, at, axis=0)) for a in (peak, inner, edge)]]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)
            pos, x = pos[-TAPS:], x[-TAPS:]

    # Beyond six frames after a block's last sample an output counts only if the track goes on.
    found = d.mapInArrow(run, schema).withColumn("_last", F.max("_f").over(Window.partitionBy(*keys)))
    goes_on = F.col("_f") < F.col("_last")

    def top(c: str, v: int) -> Column:
        return F.max(F.when(F.col("_some"), F.col(c)[v]))

    g = found.groupBy(*keys).agg(
        F.array(*[top("_s", v) for v in range(n)]).alias("sample_peaks"),
        F.array(*[F.greatest(top("_s", v), top("_i", v), F.max(F.when(goes_on, F.col("_e")[v]))) for v in range(n)]).alias("true_peaks"))
    return g.select(*keys, "sample_peaks", "true_peaks")


def true_peak(samples: DataFrame, keys: list[str], frame: str, channels: list[str]) -> DataFrame:
    """Largest interpolated magnitude per key, with the six-frame tail at the end; see true_peaks()."""
    d = true_peaks(samples, keys, frame, channels, [F.lit(1.0)])
    return d.select(*keys, F.col("sample_peaks")[0].alias("sample_peak"), F.col("true_peaks")[0].alias("true_peak"))


def hard_clip_ceiling(peak: Column, reduction_db: Column) -> Column:
    """Ceiling that lowers the highest peak by the wanted number of dB."""
    return peak * F.pow(F.lit(10.0), -reduction_db / 20)


def reduction_db(before: Column, after: Column) -> Column:
    """Gain reduction of a hop; 0 when either side is silent."""
    return F.when((before > 0) & (after > 0), 20 * F.log10(after / before)).otherwise(F.lit(0.0))


def waveform_columns(samples: DataFrame, lengths: DataFrame, keys: list[str], frame: str, peak: Column, width: int, block: int = 256) -> DataFrame:
    """Peaks of `width` equal pixel ranges from a two-level index.

    Whole blocks answer from their stored peak; only samples of the partial
    blocks at a range's edges are looked at one by one.
    """
    s = samples.select(*keys, F.col(frame).alias("_f"), peak.alias("_p")).withColumn("_blk", F.expr(f"_f div {block}"))
    index = s.groupBy(*keys, "_blk").agg(F.max("_p").alias("_p"))
    cols = (
        lengths.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("start", F.expr(f"(col * frames) div {width}"))
        .withColumn("end", F.expr(f"((col + 1) * frames + {width - 1}) div {width}"))
        .withColumn("_w0", F.ceil(F.col("start") / block))
        .withColumn("_w1", F.expr(f"end div {block}"))
    )
    c = [*keys, "col", "start", "end"]
    whole = cols.where("_w0 < _w1").select(*c, F.explode(F.sequence(F.col("_w0"), F.col("_w1") - 1)).alias("_blk")).join(index, [*keys, "_blk"])
    edge_blocks = F.when(
        F.col("_w0") < F.col("_w1"), F.filter(F.array(F.col("_w0") - 1, F.col("_w1")), lambda b: (b * block < F.col("end")) & ((b + 1) * block > F.col("start")))
    ).otherwise(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}")))
    edges = cols.select(*c, F.explode(F.array_distinct(edge_blocks)).alias("_blk")).join(s, [*keys, "_blk"]).where("_f >= start AND _f < end")
    hit = whole.select(*keys, "col", "_p").unionByName(edges.select(*keys, "col", "_p")).groupBy(*keys, "col").agg(F.max("_p").alias("peak"))
    return cols.select(*c).join(hit, [*keys, "col"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
