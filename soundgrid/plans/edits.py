"""Edits of whole tracks expressed as predicates and re-based frames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trim(samples: DataFrame, lengths: DataFrame, keys: list[str], head: int, tail: int, frame: str = "frame", length: str = "frames") -> DataFrame:
    """Keep [head, length - tail) and re-base; a track with nothing left is a failure.

    Failed tracks keep their rows with a reason, so the caller can route them.
    """
    d = samples.join(lengths, keys)
    bad = F.lit(head + tail) >= F.col(length)
    inside = (F.col(frame) >= head) & (F.col(frame) < F.col(length) - tail)
    return (
        d.where(bad | inside)
        .withColumn("failure", F.when(bad, "nothing_left"))
        .withColumn(frame, F.col(frame) - head)
        .withColumn(length, F.col(length) - head - tail)
    )
