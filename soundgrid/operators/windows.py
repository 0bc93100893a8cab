"""Window operators along a track's cells."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.functions import quantiles
from soundgrid.operators.blocks import halo, running
from soundgrid.session import materialise


def moving_average(df: DataFrame, keys: list[str], pos: str, value: str, radius: int, out: str) -> DataFrame:
    """Centred mean, clipped at the ends."""
    h = halo(df, keys, pos, radius, radius)
    return h.with_columns({out: F.avg(value).over(h.reach(radius, radius))}).own()


def triangular(df: DataFrame, keys: list[str], pos: str, last: str, value: str, radius: int, out: str) -> DataFrame:
    """Triangular weights with the end values repeated outside.

    A triangle is a box of a box; the repeated ends are real rows of the halo and
    leave with it.
    """
    p = F.col(pos)
    pad = F.array_union(
        F.when(p == 0, F.sequence(F.lit(-radius).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.array(p)),
        F.when(p == F.col(last), F.sequence(p, p + radius)).otherwise(F.array(p)),
    )
    padded = df.withColumn("_at", F.explode(pad))
    h = halo(padded, keys, "_at", radius, radius)
    h = h.with_columns({"_box": F.sum(value).over(h.reach(radius, 0))})
    h = h.with_columns({out: F.sum("_box").over(h.reach(0, radius)) / ((radius + 1) ** 2)})
    return h.own().where(F.col("_at") == p).drop("_at", "_box")


def frame_mean(df: DataFrame, keys: list[str], pos: str, energy: str, n: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Energy means over several frames around each cell, weighted by true length.

    A span (a, b) covers the cells [pos + a, pos + b). Spans that leave the track
    give NULL.
    """
    before = max([-a for a, _ in spans.values()] + [0])
    after = max([b - 1 for _, b in spans.values()] + [0])
    h = halo(df, keys, pos, before, after)
    cols = {}
    for name, (a, b) in spans.items():
        w = h.window.rangeBetween(a, b - 1)
        cols[name] = F.when(F.count(energy).over(w) == b - a, F.sum(energy).over(w) / F.sum(n).over(w))
    return h.with_columns(cols).own()


def local_maxima(df: DataFrame, keys: list[str], pos: str, value: str, reach: int, out: str = "is_max") -> DataFrame:
    """Largest within +-reach; of equal values the earlier wins."""
    h = halo(df, keys, pos, reach, reach)
    left, right = F.max(value).over(h.reach(reach, -1)), F.max(value).over(h.window.rangeBetween(1, reach))
    v = F.col(value)
    ok = (left.isNull() | (v > left)) & (right.isNull() | (v >= right))
    return h.with_columns({out: ok}).own()


_TRANSFER = T.StructType([T.StructField("upper", T.ArrayType(T.LongType())), T.StructField("exit", T.ArrayType(T.LongType()))])


def _transfers(gap: int, size: int):
    @F.pandas_udf(_TRANSFER)
    def transfer(start: pd.Series, places: pd.Series) -> pd.DataFrame:
        """What a block of candidates does to the first free position: the exit of the first upper bound that is not below the entry."""
        rows = []
        for first, own in zip(start, places, strict=True):
            c = np.asarray(own, np.int64)
            following = np.searchsorted(c, c + gap)
            leave = np.empty(len(c), np.int64)
            for i in range(len(c) - 1, -1, -1):
                leave[i] = leave[following[i]] if following[i] < len(c) else c[i] + gap
            end = first + size
            use = min(len(c), int(np.searchsorted(c, first + gap)) + 1)
            upper, exits = c[:use], leave[:use]
            if c[use - 1] < first + gap:  # an entry may lie behind all candidates
                upper, exits = np.append(upper, end), np.append(exits, end)
            exits = np.maximum(exits, end)
            change = np.append(exits[1:] != exits[:-1], True)  # the last of equal exits
            rows.append((upper[change], exits[change]))
        return pd.DataFrame(rows, columns=_TRANSFER.names)

    return transfer


def _kept(gap: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def kept(entry: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for free, own in zip(entry, places, strict=True):
            c, chosen = np.asarray(own, np.int64), []
            at = int(np.searchsorted(c, free))
            while at < len(c):
                chosen.append(int(c[at]))
                at = int(np.searchsorted(c, c[at] + gap))
            out.append(chosen)
        return pd.Series(out)

    return kept


def greedy_gap(df: DataFrame, keys: list[str], pos: str, gap: int, block: int = 4096) -> DataFrame:
    """Keep a candidate only when it is at least `gap` after the last kept one.

    Positions are distinct and not negative. A block of positions turns the first
    free position at its start into that of the next block: a step function with
    few steps, most often one, as different entries soon meet in one candidate.
    Blocks that still depend on their entry take over their predecessor's function,
    which doubles the blocks covered by each round, until all entries are known. A
    task holds the candidates of single blocks, however long a run is.
    """
    size = max(block, gap)
    d = df.select(*keys, F.col(pos).cast("long").alias("_p")).withColumn("_block", F.expr(f"_p div {size}"))
    d = d.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_p")).alias("_places"))  # `size` at most
    d = materialise(d.withColumn("_t", _transfers(gap, size)(F.col("_block") * size, "_places")))
    own = [*keys, "_block"]
    pieces = d.select(*own, F.col("_block").alias("_from"), F.arrays_zip(F.col("_t.upper").alias("upper"), F.col("_t.exit").alias("exit")).alias("_f"))

    def of(f: Column, x: Column) -> Column:
        return F.filter(f, lambda p: p["upper"] >= x)[0]["exit"]

    now = pieces.withColumn("_exit", F.when(F.size("_f") == 1, F.col("_f")[0]["exit"]))
    while True:
        prior = now.select(*keys, (F.col("_block") + 1).alias("_from"), F.col("_f").alias("_g"), F.col("_exit").alias("_e"), F.col("_from").alias("_back"))
        met = now.join(prior, [*keys, "_from"], "left")
        entry = F.when(F.col("_back").isNull(), F.col("_from") * size).otherwise(F.col("_e"))  # no candidates before: all is free
        known = F.coalesce("_exit", F.when(entry.isNotNull(), of(F.col("_f"), entry)))
        longer = F.when(known.isNull(), F.transform("_g", lambda p: F.struct(p["upper"], of(F.col("_f"), p["exit"]).alias("exit")))).otherwise(F.col("_f"))
        step = met.select(*own, F.when(known.isNull(), F.col("_back")).otherwise(F.col("_from")).alias("_from"), longer.alias("_f"), known.alias("_exit"))
        now = materialise(step)
        if now.where("_exit IS NULL").isEmpty():
            break
    before = now.select(*keys, (F.col("_block") + 1).alias("_block"), "_exit")
    d = d.join(before, own, "left").withColumn("_entry", F.coalesce("_exit", F.col("_block") * size))
    return d.select(*keys, F.explode(_kept(gap)("_entry", "_places")).alias(pos))


def forward_min(df: DataFrame, keys: list[str], pos: str, value: str, look: int, out: str) -> DataFrame:
    """Minimum over the next `look` cells. Wide frames go through block minima."""
    if look <= 128:
        h = halo(df, keys, pos, 0, look)
        return h.with_columns({out: F.min(value).over(h.reach(0, look))}).own()
    # A frame of look + 1 cells spans the rest of its own block and a prefix of the next.
    size = look + 1
    d = df.withColumn("_b", F.floor(F.col(pos) / size))
    tail = running(d, [*keys, "_b"], pos, {"_tail": ("min", F.col(value))}, forward=False)
    head = running(d, [*keys, "_b"], pos, {"_head": ("min", F.col(value))}).select(
        *keys, (F.col(pos) - look).alias(pos), "_head")
    ends = d.groupBy(*keys, "_b").agg(F.min(value).alias("_all")).withColumn("_b", F.col("_b") - 1)
    return (
        tail.join(head, [*keys, pos], "left").join(ends, [*keys, "_b"], "left")
        .withColumn(out, F.least("_tail", F.coalesce("_head", "_all")))
        .drop("_b", "_tail", "_head", "_all")
    )


def slew_limit(df: DataFrame, keys: list[str], pos: str, value: str, rise: float, attack: float, out: str) -> DataFrame:
    """Limit the rise per cell forwards, then the fall per cell by looking ahead.

    g[i] = min over j <= i of (g[j] + rise (i - j)): a running minimum.
    """
    i = F.col(pos)
    d = running(materialise(df), keys, pos, {"_f": ("min", F.col(value) - rise * i)}).withColumn("_g", F.col("_f") + rise * i)
    d = running(d, keys, pos, {"_b": ("min", F.col("_g") + attack * i)}, forward=False)
    return d.withColumn(out, F.col("_b") - attack * i).drop("_f", "_g", "_b")


def robust_scale(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(x - median) / MAD clipped at zero; P95 - median where the MAD is zero.

    Lower medians; exact for tracks of any length.
    """
    df = materialise(df)
    m = quantiles.grouped(df, keys, {"_med": (value, 0.5, "lower"), "_p95": (value, 0.95, "lower")})
    d = materialise(df.join(m, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med"))))
    mad = quantiles.grouped(d, keys, {"_mad": ("_dev", 0.5, "lower")})
    unit = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.greatest(F.col("_p95") - F.col("_med"), F.lit(1e-12)))
    return d.join(mad, keys).withColumn(out, F.greatest(F.lit(0.0), (F.col(value) - F.col("_med")) / unit)).drop(
        "_med", "_p95", "_dev", "_mad")


def positive_flux(now: Column, before: Column) -> Column:
    """Sum of the positive differences of two magnitude arrays; no predecessor counts as zeros."""
    rise = F.zip_with(now, F.coalesce(before, F.transform(now, lambda _: F.lit(0.0))), lambda a, b: F.greatest(F.lit(0.0), a - b))
    return F.aggregate(rise, F.lit(0.0), lambda s, x: s + x)


def longest_run(df: DataFrame, keys: list[str], pos: str, flag: Column, out: str) -> DataFrame:
    """Length of the longest run of set flags per key, with the number not set."""
    d = df.select(*keys, pos, flag.alias("_f"))
    d = running(d, keys, pos, {"_ok": ("sum", (~F.col("_f")).cast("bigint"))})
    runs = d.groupBy(*keys, "_ok").agg(F.sum(F.col("_f").cast("bigint")).alias("_len"), F.sum((~F.col("_f")).cast("bigint")).alias("_clear"))
    return runs.groupBy(*keys).agg(F.max("_len").alias(out), F.sum("_clear").alias("clear"))
