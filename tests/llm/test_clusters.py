"""Centroid clustering against plain Python integers."""
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm import clusters

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def brute(rows, k, rounds, width, scale, seed):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centres)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centres


def check(spark, rows, k=4, rounds=3, width=6, scale=16):
    made, centres = clusters.assign(spark.createDataFrame(rows, VEC).withColumn("cluster", F.lit("own")).withColumn("x", F.lit(1)), k, rounds, width, scale, "s")
    want, final = brute(rows, k, rounds, width, scale, "s")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(want, key=key)
    assert [[int(x) for x in c] for c in centres] == final
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    assert clusters.inertias(made) == sums


def vectors(n, width, seed, spread=3.0):
    r = random.Random(seed)
    centres = [[r.uniform(-spread, spread) for _ in range(width)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(n)]


def test_clusters_are_exact(spark):
    check(spark, vectors(400, 6, 1), k=6, rounds=5)
    check(spark, vectors(60, 6, 2, spread=0.01), k=8)


def test_ties_repeats_and_odd_rows(spark):
    same = [(i, [1.0] * 6) for i in range(20)] + [(i, [1.0] * 6) for i in range(5)]
    odd = [(None, [0.5] * 6), (None, None), (50, []), (51, [1.0] * 5), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [float("nan")] * 6), (54, [float("inf")] + [0.0] * 5), (55, [-0.01] * 6)]
    check(spark, same, k=3)
    check(spark, same + odd + vectors(30, 6, 3), k=5)
    check(spark, [(1, [0.0] * 6), (2, [2.0] * 6), (3, [1.0] * 6)], k=2, rounds=0, scale=1)
    check(spark, odd[:2], k=2)
    check(spark, [], k=2)
    check(spark, [(1, [0.25] * 6)], k=8)


def test_large_components_stay_exact(spark):
    rows = vectors(40, 6, 4) + [(100 + i, [3.0e7 + i, -2.5e7, float(i), 0.0, 1e7, -1e8 * (i % 2)]) for i in range(10)]
    check(spark, rows, k=5, scale=2)


@pytest.mark.parametrize("width", [1, 3, 20])
def test_bounds_hold_and_prune(width):
    r = np.random.default_rng(7)
    centres = r.integers(-4000, 4000, (12, width))
    x = centres[r.integers(0, 12, 3000)] + r.integers(-300, 300, (3000, width))
    base = clusters.simplex(x[:200], 8)
    a, c = base.apexes(x), base.apexes(centres)
    true = ((x[:, None] - centres[None]) ** 2).sum(2).astype(float)
    lower = ((a[:, None] - c[None]) ** 2).sum(2)
    upper = lower + 4 * a[:, -1:] * c[None, :, -1]
    assert (lower <= true * (1 + 1e-6) + 1).all() and (upper >= true * (1 - 1e-6) - 1).all()
    number, far, compared = clusters.nearest(x, a, centres, c)
    assert (number == true.argmin(1)).all() and (far == true.min(1)).all()
    assert compared < 3000 * 12 / 2
