"""Range, interval and as-of joins.

A range predicate is turned into an equality on (track, bucket) with the exact
predicate kept as a residual, so the join shuffles on a fine key and only
neighbouring rows ever meet. As-of lookups are a union and a carried value, which
needs no join at all.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundgrid.operators.blocks import BLOCK, nearest_marks

#: Hint of joins whose sides both grow with the catalogue. Segments pack so well in files that Spark takes millions of them for a table to broadcast, which the driver has to hold unpacked.
MERGE = "merge"


def range_join(ranges: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, pos: str, bucket: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Ranges [lo, hi] (both inclusive) with the points inside, keys equal; `hint` names Spark's way of joining."""
    r = ranges.where(F.col(lo) <= F.col(hi)) if how == "inner" else ranges
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(pos) / bucket))
    on = [*keys, "_b"]
    return r.join(p.hint(hint) if hint else p, on, how).where((F.col(pos) >= F.col(lo)) & (F.col(pos) <= F.col(hi))).drop("_b")


def asof(points: DataFrame, marks: DataFrame, keys: list[str], pos: str, mark_pos: str, payload: str,
         before: str | None = None, after: str | None = None, block: int = BLOCK) -> DataFrame:
    """Latest mark at or before each point and/or the earliest at or after it.

    Only the distinct positions go through the blocks, so a block holds a bounded
    number of rows however many points share a position.
    """
    places = points.select(*keys, pos).distinct()
    p = places.withColumn("_m", F.lit(None).cast(marks.schema[payload].dataType)).withColumn("_kind", F.lit(1))
    m = marks.select(*keys, F.col(mark_pos).alias(pos), F.col(payload).alias("_m"), F.lit(0).alias("_kind"))
    u = p.unionByName(m, allowMissingColumns=True)
    found = nearest_marks(u, keys, pos, "_m", before, after, ["_kind"], block).where("_kind = 1").drop("_m", "_kind")
    return points.join(found, [*keys, pos], "left")


def overlap_resample(cells: DataFrame, keys: list[str], pos: str, length: Column, value: str, bins: int) -> DataFrame:
    """Resample unit cells to a fixed number of bins by overlap weight.

    Each cell goes to the bins it overlaps; weights are lengths of overlap.
    """
    w = length / bins
    p = F.col(pos)
    first = F.floor(p / w)
    last = F.least(F.lit(bins - 1).cast("bigint"), F.ceil((p + 1) / w) - 1)
    d = cells.withColumn("_w", w).withColumn("bin", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), first - 1), F.greatest(first, last))))
    lo, hi = F.col("bin") * length / bins, (F.col("bin") + 1) * length / bins
    part = F.least(hi, p + 1) - F.greatest(lo, p)
    return (
        d.withColumn("_p", part).where("_p > 0")
        .groupBy(*keys, "bin").agg((F.sum(F.col("_p") * F.col(value)) / F.max("_w")).alias("value"))
    )


def nearest_long_cell(short: DataFrame, keys: list[str], width: int, long_width: int) -> DataFrame:
    """Nearest long cell by centre for each short cell: three candidates, the first wins ties.

    Pure arithmetic on the two clocks; `short` has cell and frames.
    """

    def center(i: Column, w: int) -> Column:
        return i * w + F.floor((F.least(F.col("frames"), (i + 1) * w) - i * w - 1) / 2)

    top = F.expr(f"(frames - 1) div {long_width}")
    at = center(F.col("cell"), width)
    home = F.least(top, F.floor(at / long_width))
    options = F.filter(F.array(home - 1, home, home + 1), lambda i: (i >= 0) & (i <= top))
    best = F.array_min(F.transform(options, lambda i: F.struct(F.abs(center(i, long_width) - at).alias("gap"), i.alias("nearest"))))
    return short.withColumn("_best", best).select(*keys, "cell", "_best.nearest", "_best.gap")
