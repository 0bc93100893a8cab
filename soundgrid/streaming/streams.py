"""Bounded-memory forms of the measurements as Structured Streaming queries.

Windows close by event time behind a watermark; keyed carries live in the state
store. Fed the same samples, each gives the batch operator's numbers.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from soundgrid.functions import scalar
from soundgrid.operators import kernels, peaks
from soundgrid.session import shared_folder

#: Ticks of a track that are transformed together.
TICKS_AT_ONCE = 64


def read_table(spark: SparkSession, root: str, name: str, per_trigger: int = 64) -> DataFrame:
    """A table (one file, or a folder of files) as a stream of its files, with the schema of the table and no inference."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    exactly = f"[{name[0]}]{name[1:]}.parquet"  # as a pattern, a single file is accepted too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/{exactly}")


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over everything available and return the latest row per key.

    Micro-batches are written to the shared folder with their number, so a batch
    that runs twice after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/soundgrid-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows; give a longer delay, or none for a replay")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    if not keys:
        return rows.drop("batch")
    value = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("_v")).select(*keys, "_v.*")


def at_frame(frame: Column | str, rate: int) -> Column:
    """Event time of a frame: catalogue seconds from the epoch, independent of any time zone."""
    c = F.col(frame) if isinstance(frame, str) else frame
    return F.timestamp_micros((c * (1_000_000 // rate)).cast("bigint"))


def sliding_sums(samples: DataFrame, keys: list[str], rate: int, size: int, hop: int, sums: dict[str, Column], late: str | None = None) -> DataFrame:
    """Sums of every window of `size` frames each `hop` frames, by event time.

    Without `late` every window stays open, so a replay may bring its files in any
    order. A live source names the disorder it may have; rows beyond that make
    drain() fail instead of being lost.
    """
    us = 1_000_000 // rate
    s = samples.withColumn("_at", at_frame("frame", rate))
    s = s.withWatermark("_at", late) if late else s
    w = F.window("_at", f"{size * us} microseconds", f"{hop * us} microseconds")
    g = s.groupBy(*keys, w.alias("_w")).agg(*[c.alias(n) for n, c in sums.items()])
    start = F.unix_micros("_w.start") / us
    return g.select(*keys, F.round(start / hop).cast("bigint").alias("win"), *sums)


def lengths(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Frames seen so far per key."""
    return samples.groupBy(*keys).agg((F.max("frame") + 1).alias("frames"))


def incremental_loudness(sums: DataFrame, ends: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Power and level of the complete windows, from the drained sums and lengths."""
    d = sums.join(ends, keys).where((F.col("win") >= 0) & (F.col("win") * hop + size <= F.col("frames")))
    return d.select(*keys, "win", (F.col("energy") / size).alias("power")).withColumn("lufs", scalar.lufs(F.col("power")))


def windows_with_tail(sums: DataFrame, ends: DataFrame, keys: list[str], size: int, hop: int, cols: list[str]) -> DataFrame:
    """Complete windows, and on close one partial tail if it adds frames."""
    full = F.when(F.col("frames") >= size, F.floor((F.col("frames") - size) / hop) + 1).otherwise(F.lit(0).cast("bigint"))
    seen = F.when(F.col("_full") > 0, (F.col("_full") - 1) * hop + size).otherwise(F.lit(0))
    d = sums.join(ends, keys).withColumn("_full", full)
    tail = (F.col("win") == F.col("_full")) & (F.col("frames") > F.col("win") * hop) & (F.col("frames") > seen)
    d = d.where((F.col("win") >= 0) & ((F.col("win") < F.col("_full")) | tail))
    return d.select(
        *keys, "win", (F.col("win") * hop).alias("start"), F.least(F.col("win") * hop + size, F.col("frames")).alias("end"),
        (F.col("win") >= F.col("_full")).alias("partial"), *cols)


def frame_sums(samples: DataFrame, key: str) -> DataFrame:
    """Left and right per track and frame so far; frames may arrive in any order and in parts."""
    return samples.groupBy(key, "frame").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def true_peak(samples: DataFrame, key: str) -> DataFrame:
    """True peak and length per track, from a stream in any order.

    The state is one row per sounding frame; the interpolation runs on the drained
    frames and includes the six-frame tail that would follow if the track ended now.
    """
    frames = drain(frame_sums(samples, key), [key, "frame"])
    return peaks.true_peak(frames, [key], "frame", ["l", "r"]).join(frames.groupBy(key).agg((F.max("frame") + 1).alias("frames")), key).select(key, "frames", "true_peak")


def tick_levels(f: np.ndarray, x: np.ndarray, ends: np.ndarray, win: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smoothed levels of the buffers that end at these frames, all ticks at once: [tick, band lo .. hi].

    f: sounding frames in order, x: their samples per channel.
    """
    fft = len(win)
    lead, stop = np.searchsorted(f, ends - fft, "right"), np.searchsorted(f, ends, "right")
    n = stop - lead
    row = np.repeat(np.arange(len(ends)), n)
    at = np.arange(n.sum()) + np.repeat(lead - np.cumsum(n) + n, n)
    buf = np.zeros((2, len(ends), fft))
    for c in range(2):
        np.add.at(buf[c], (row, f[at] - (ends[row] - fft + 1)), x[c, at])
    p = (np.abs(np.fft.rfft(buf * win)) ** 2).mean(0)
    sums = np.concatenate([np.zeros((len(ends), 1)), np.cumsum(p, axis=1)], axis=1)
    raw = 10 * np.log10(np.maximum((sums[:, hi + 1] - sums[:, lo]) / (hi - lo + 1), 1e-12))
    return np.stack([raw[:, max(0, i - 6):i + 7].mean(1) for i in range(raw.shape[1])], axis=1)


def live_spectrum(samples: DataFrame, key: str, rate: int, fft: int, hz: list[float], rise: float = 0.6, fall: float = 0.12, hop: int | None = None) -> DataFrame:
    """Display spectrum per track: fast rise, slow fall, a peak line that decays.

    A tick each `hop` frames (half a buffer) once a full buffer has passed, so ticks
    do not depend on the triggers. Frames of a track arrive in order over the
    triggers; a frame before the last trigger's makes the query fail. State: the
    samples of the last buffer and hop, the curve and its peak line.
    """
    hop = hop or fft // 2
    out = f"{key} bigint, ticks int, top_db double, curve array<double>"
    state = "first bigint, pos array<bigint>, l array<double>, r array<double>, curve array<double>, top double, ticks int"
    win = kernels.hann(fft)
    grid = np.asarray(hz)
    lo = np.clip(np.floor(grid * 2 ** (-1 / 24) * fft / rate).astype(int), 1, fft // 2)
    hi = np.maximum(lo, np.minimum(fft // 2, np.ceil(grid * 2 ** (1 / 24) * fft / rate).astype(int)))

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        first, pos, l, r, curve, top, ticks = st.get if st.exists else (0, [], [], [], [-120.0] * len(grid), -40.0, 0)
        pdf = pd.concat(list(batches)).sort_values("frame", kind="stable")
        new = pdf["frame"].to_numpy()
        if pos and new[0] < pos[-1]:
            raise ValueError(f"frame {new[0]} of track {k[0]} arrived after frame {pos[-1]}")
        f = np.concatenate([np.asarray(pos, dtype=np.int64), new])
        x = np.stack([np.concatenate([l, pdf["l"]]), np.concatenate([r, pdf["r"]])])
        due = first + fft - 1 + ticks * hop
        new_ticks = max(0, -(-int(f[-1] - due) // hop))
        for at in range(0, new_ticks, TICKS_AT_ONCE):
            ends = due + hop * np.arange(min(TICKS_AT_ONCE, new_ticks - at))
            for goal in tick_levels(f, x, ends, win, lo, hi):
                c = np.asarray(curve)
                curve = c + (goal - c) * np.where(goal > c, rise, fall)
                top = max(float(curve.max()), top - 0.05)
            curve, ticks, due = [float(v) for v in curve], ticks + len(ends), due + hop * len(ends)
        keep = f > due - fft
        keep[-1] = True
        f, x = f[keep], x[:, keep]
        st.update((first, [int(v) for v in f], [float(v) for v in x[0]], [float(v) for v in x[1]], list(curve), top, ticks))
        yield pd.DataFrame({key: [k[0]], "ticks": [ticks], "top_db": [top], "curve": [list(curve)]})

    return samples.groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def clock_drift(progress: DataFrame, limit: float = 0.75, after: float = 10.0) -> DataFrame:
    """Progress rows whose captured clock is off: columns elapsed and captured in seconds."""
    return progress.where((F.col("elapsed") > after) & (F.abs(F.col("captured") - F.col("elapsed")) > limit))
