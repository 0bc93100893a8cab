"""PCM WAV files to chunk rows, with per-file failures instead of a failed job."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundgrid.sources.catalogue import scan

SCHEMA = "path string, rate int, channels int, frames bigint, chunk bigint, start_frame bigint, l array<float>, r array<float>, failure string"


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and float samples (frames x channels); 16, 24, 32-bit integer or 32-bit float."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not_a_wav")
    fmt, body, at = None, None, 12
    while at + 8 <= len(data):
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
            if fmt[0] == 0xFFFE and size >= 26:  # extensible: the real tag starts the sub-format
                fmt = (struct.unpack_from("<H", data, at + 32)[0], *fmt[1:])
        elif name == b"data":
            if at + 8 + size > len(data):
                raise ValueError("truncated")
            body = data[at + 8:at + 8 + size]
        at += 8 + size + (size & 1)
    if fmt is None or body is None:
        raise ValueError("missing_chunk")
    tag, channels, rate, _, align, bits = fmt
    if tag not in (1, 3) or bits not in (16, 24, 32) or channels not in (1, 2) or (tag == 3 and bits != 32) or rate <= 0:
        raise ValueError("unsupported_format")
    if align != channels * bits // 8 or len(body) % align:
        raise ValueError("incomplete_frame")
    if tag == 3:
        x = np.frombuffer(body, "<f4").astype(np.float32)
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        v = (b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)
        x = ((v >> 8) / 8388608.0).astype(np.float32)
    else:
        x = (np.frombuffer(body, f"<i{bits // 8}") / float(2 ** (bits - 1))).astype(np.float32)
    if not np.isfinite(x).all():
        raise ValueError("non_finite_sample")
    return rate, x.reshape(-1, channels)


def ingest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per 100 ms chunk; a file that cannot be read is one row with its failure."""
    content = F.when(F.col("kind") == "mp3", F.lit(None)).otherwise(F.col("content"))
    files = scan(spark, folder, pattern).select("path", content.alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if content is None:
                        raise ValueError("mp3_not_decoded")
                    rate, x = decode(bytes(content))
                    if not len(x):
                        raise ValueError("empty")
                except ValueError as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, None, None, str(e))], columns=[c.split()[0] for c in SCHEMA.split(", ")])
                    continue
                hop = max(1, int(0.1 * rate + 0.5))
                starts = np.arange(0, len(x), hop)
                left, right = x[:, 0], x[:, -1]
                yield pd.DataFrame({
                    "path": path, "rate": rate, "channels": x.shape[1], "frames": len(x), "chunk": starts // hop, "start_frame": starts,
                    "l": [left[s:s + hop] for s in starts], "r": [right[s:s + hop] for s in starts], "failure": None})

    return files.mapInPandas(run, SCHEMA)


def tracks(ingested: DataFrame) -> DataFrame:
    return ingested.where("failure IS NULL AND chunk = 0").select("path", "rate", "channels", "frames")


def failures(ingested: DataFrame) -> DataFrame:
    return ingested.where("failure IS NOT NULL").select("path", F.col("failure").alias("reason"))


def samples(ingested: DataFrame) -> DataFrame:
    """Long form (path, frame, l, r) for small jobs and tests."""
    d = ingested.where("failure IS NULL").select("path", "start_frame", F.posexplode(F.arrays_zip("l", "r")).alias("i", "x"))
    return d.select("path", (F.col("start_frame") + F.col("i")).alias("frame"), F.col("x.l").cast("double").alias("l"), F.col("x.r").cast("double").alias("r"))
