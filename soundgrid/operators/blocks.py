"""Skew-safe ordered windows.

A window partitioned by the track alone puts a whole track in one task. Here a
frame of fixed reach is computed per (track, block of positions) instead: each
row is copied into the few blocks whose rows can see it, so the work of one hot
track spreads over all its blocks. Running (unbounded) sums use per-block totals.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096
#: Rows, about, that spread() leaves to one task.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Halo:
    """Rows with their block number; `window` orders one block by position."""

    df: DataFrame
    keys: list[str]
    pos: str
    block: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk").orderBy(self.pos)

    def reach(self, before: int, after: int) -> WindowSpec:
        """Frame by position value: gaps in the positions do not stretch it."""
        return self.window.rangeBetween(-before, after)

    def with_columns(self, cols: dict[str, Column]) -> "Halo":
        return Halo(self.df.withColumns(cols), self.keys, self.pos, self.block)

    def spread(self, rows: int) -> "Halo":
        """Blocks dealt over as many partitions as a table of so many rows needs, so that what a task sorts does not grow with the table.

        Shuffled bytes say little about dense cells: silence packs well, and the rows
        behind it come back in full.
        """
        n = max(self.df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
        return Halo(self.df.repartition(n, *self.keys, "_blk"), self.keys, self.pos, self.block)

    def own(self) -> DataFrame:
        """Only the rows a block is responsible for."""
        return self.df.where(F.floor(F.col(self.pos) / self.block) == F.col("_blk")).drop("_blk")


def halo(df: DataFrame, keys: list[str], pos: str, before: int, after: int, block: int = BLOCK) -> Halo:
    size = max(block, 32 * (before + after + 1))
    p = F.col(pos)
    blocks = F.sequence(F.floor((p - after) / size), F.floor((p + before) / size))
    return Halo(df.withColumn("_blk", F.explode(blocks)), list(keys), pos, size)


_FOLDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, keys: list[str], pos: str, outs: dict[str, tuple[str, Column]], *, before_only: bool = False,
            forward: bool = True, tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Running sum/max/min along `pos`, two-level: block totals first, then inside a block.

    `outs` maps a new column to (fold, expression). `before_only` leaves the row
    itself out; `forward=False` runs from the end.
    """
    sign = 1 if forward else -1
    d = df.withColumn("_blk", F.floor(F.col(pos) / block))
    for i, (_, c) in enumerate(outs.values()):
        d = d.withColumn(f"_x{i}", c)
    totals = d.groupBy(*keys, "_blk").agg(*[_FOLDS[f][0](f"_x{i}").alias(f"_t{i}") for i, (f, _) in enumerate(outs.values())])
    earlier = Window.partitionBy(*keys).orderBy(F.col("_blk") * sign).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", *[_FOLDS[f][0](f"_t{i}").over(earlier).alias(f"_o{i}") for i, (f, _) in enumerate(outs.values())])
    order = [F.col(pos) * sign] + [F.col(t) * sign for t in (tie or [])]
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    d = d.withColumns({f"_r{i}": _FOLDS[f][0](f"_x{i}").over(inside) for i, (f, _) in enumerate(outs.values())})
    out = d.join(offsets, [*keys, "_blk"])
    for i, (name, (f, _)) in enumerate(outs.items()):
        out = out.withColumn(name, _FOLDS[f][1](F.col(f"_o{i}"), F.col(f"_r{i}")))
    return out.drop("_blk", *[f"_{a}{i}" for i in range(len(outs)) for a in "xro"])


def previous_row(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Columns of the row before, whatever the gap; block ends carry over."""
    d = df.withColumn("_blk", F.floor(F.col(pos) / block))
    take = F.struct(*cols.values())
    ends = d.groupBy(*keys, "_blk").agg(F.max_by(take, pos).alias("_end"))
    carry = ends.select(*keys, "_blk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos)
    d = d.withColumn("_prev", F.lag(take).over(inside)).join(carry, [*keys, "_blk"])
    prev = F.coalesce("_prev", "_carry")
    return d.withColumns({new: prev[old] for new, old in cols.items()}).drop("_blk", "_prev", "_carry")


def nearest_marks(df: DataFrame, keys: list[str], pos: str, mark: str, before: str | None, after: str | None,
                  tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Last non-NULL `mark` at or before each row and/or first one at or after it.

    Works per block; the carry into a block is found over one row per block. `tie`
    puts marks before the other rows of the same position, in both directions.
    """
    d = df.withColumn("_blk", F.floor(F.col(pos) / block))
    at = F.when(F.col(mark).isNotNull(), F.col(pos))
    ends = d.groupBy(*keys, "_blk").agg(F.max_by(mark, at).alias("_last"), F.min_by(mark, at).alias("_first"))
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        *keys, "_blk", F.last("_last", ignorenulls=True).over(past).alias("_cb"), F.first("_first", ignorenulls=True).over(ahead).alias("_ca"))
    inside = Window.partitionBy(*keys, "_blk")
    ties = [F.col(t) for t in (tie or [])]
    upto = (Window.unboundedPreceding, 0)
    cols = {}
    if before:
        cols[before] = F.last(mark, ignorenulls=True).over(inside.orderBy(F.col(pos), *ties).rowsBetween(*upto))
    if after:
        cols[after] = F.last(mark, ignorenulls=True).over(inside.orderBy(F.col(pos).desc(), *ties).rowsBetween(*upto))
    d = d.withColumns(cols).join(carry, [*keys, "_blk"])
    for name, c in ((before, "_cb"), (after, "_ca")):
        if name:
            d = d.withColumn(name, F.coalesce(name, c))
    return d.drop("_blk", "_cb", "_ca")
