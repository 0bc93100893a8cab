"""The quantile conventions in use, one helper each.

Two families: aggregate expressions for groups whose size the time grid bounds
(cells of one track), and `order_statistics` for groups of unbounded size.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(x: Column | str, p: float) -> Column:
    """Linear interpolation between the two neighbours."""
    return F.percentile(x, p)


def lower(x: str, p: float) -> Column:
    """sorted[ceil(p n) - 1]"""
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def lower_median(x: str) -> Column:
    """sorted[(n - 1) / 2]"""
    return lower(x, 0.5)


def at_rank(x: Column | str, rank) -> Column:
    """Collected and sorted values at a rank that is a function of their number."""
    c = F.col(x) if isinstance(x, str) else x
    a = F.array_sort(F.collect_list(c))
    n = F.size(a)
    return F.when(n > 0, F.element_at(a, (rank(n) + 1).cast("int")))


def floor_rank(x: Column | str, p: float) -> Column:
    """sorted[int((n - 1) p)]"""
    return at_rank(x, lambda n: F.floor((n - 1) * p))


def upper_median(x: Column | str) -> Column:
    """sorted[n / 2]"""
    return at_rank(x, lambda n: F.floor(n / 2))


# method -> ranks (first, second) of the values taken, from the probability and the count
RANKS = {
    "linear": lambda p, n: (F.floor(p * (n - 1)), F.ceil(p * (n - 1))),
    "lower": lambda p, n: (F.ceil(p * n) - 1, F.ceil(p * n) - 1),
    "floor": lambda p, n: (F.floor((n - 1) * p), F.floor((n - 1) * p)),
    "upper": lambda p, n: (F.floor(n * p), F.floor(n * p)),
    "nearest": lambda p, n: (F.floor((n - 1) * p + 0.5), F.floor((n - 1) * p + 0.5)),
}
COLLECT_LIMIT = 1_000_000


def _builtin(col: str, p: float, method: str) -> Column:
    if method == "linear":
        return linear(col, p)
    if method == "lower":
        return lower(col, p)
    return at_rank(col, lambda n: RANKS[method](F.lit(p), n)[0])


def grouped(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float, str]], limit: int = COLLECT_LIMIT) -> DataFrame:
    """Quantiles per key, one row each: name -> (column, probability, method).

    The size of the largest group is checked first. Up to the limit a plain
    aggregation holds a group's values in one task; beyond it the exact order
    statistics below take over. The input is read more than once: pass a
    materialised table.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).collect()[0][0]  # one number
    if (largest or 0) <= limit:
        return df.groupBy(*keys).agg(*[_builtin(*spec).alias(name) for name, spec in specs.items()])
    out = df.select(*keys).distinct()
    for col in dict.fromkeys(c for c, _, _ in specs.values()):
        mine = {name: (p, m) for name, (c, p, m) in specs.items() if c == col}
        out = out.join(order_statistics(df, keys, col, mine).drop("n"), keys, "left")
    return out


def order_statistics(df: DataFrame, keys: list[str], value: str, probs: dict[str, float | tuple[float, str]], n_col: str = "n") -> DataFrame:
    """Exact quantiles of groups of any size, one row per key.

    A bounded sketch brackets every wanted rank, rows outside all brackets are
    only counted, and the few rows inside are sorted. No group is collected: a
    key that holds most of the table shuffles a fraction of a percent of itself.
    """
    slack = 0.002  # four times the rank error of the sketch
    names = list(probs)
    spec = [p if isinstance(p, tuple) else (p, "linear") for p in probs.values()]
    spread = [min(1.0, max(0.0, p + d)) for p, _ in spec for d in (-slack, slack)]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias(n_col),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", spread, 2000).alias("_q"),
    )
    small = F.col(n_col) < 2000  # the neighbour rank would leave the bracket
    want = sketch.select(
        *keys,
        n_col,
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.when(small | F.lit(spread[2 * i] <= 0.0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                    F.when(small | F.lit(spread[2 * i + 1] >= 1.0), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
                )
                for i in range(len(names))
            ]
        ).alias("_b"),
    )
    joined = rows.join(want.drop(n_col), keys)
    below = joined.groupBy(*keys).agg(
        *[F.sum((F.col("_v") < F.col("_b")[i]["lo"]).cast("long")).alias(f"_below{i}") for i in range(len(names))]
    )
    inside = (
        joined.select(*keys, "_v", F.explode(F.filter("_b", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))).alias("b"))
        .groupBy(*keys, F.col("b.i").alias("_i"), "_v")
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_cum", F.sum("_c").over(upto)).join(want.select(*keys, n_col).join(below, keys), keys)
    n = F.col(n_col)
    ends = [RANKS[m](F.lit(float(p)), n) for p, m in spec]
    cols = []
    for i, (r0, r1) in enumerate(ends):
        last = F.col(f"_below{i}") + F.col("_cum") - 1
        first = last - F.col("_c") + 1
        mine = F.col("_i") == i
        cols.append(F.struct(
            F.max(F.when(mine & (first <= r0) & (r0 <= last), F.col("_v"))).alias("a"),
            F.max(F.when(mine & (first <= r1) & (r1 <= last), F.col("_v"))).alias("b")).alias(f"_s{i}"))
    out = ranked.groupBy(*keys, n_col).agg(*cols)

    def value_of(i: int) -> Column:
        p, m = spec[i]
        a, b = F.col(f"_s{i}.a"), F.col(f"_s{i}.b")
        part = F.lit(float(p)) * (n - 1)
        return a + (b - a) * (part - F.floor(part)) if m == "linear" else a

    return out.select(*keys, n_col, *[value_of(i).alias(name) for i, name in enumerate(names)])


def lower_rank(n: int, p: float) -> int:
    """Rank of `lower` for tests."""
    return max(0, math.ceil(p * n) - 1)
