"""Exact integer clustering around centroids, filtered by an n-simplex projection.

The distances of a vector to a few pivots fix the apex of a simplex over them: one
coordinate per pivot, computed once and stored beside the vector. The Euclidean
distance of two apexes is a lower bound of the vectors' distance; with the last
coordinate mirrored it is an upper one. A centroid whose lower bound exceeds the
least upper bound can't be nearest; what remains is compared in exact integers.
"""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.session import materialise

#: Rows of which pivots are chosen, and pivots at most.
SAMPLE, PIVOTS = 512, 12
#: Rows, and components of differences, that a task works on at a time.
ROWS, CELLS = 8192, 1 << 22
#: Components up to this size are computed in 64-bit integers, larger ones in Python's.
NARROW = 1 << 25


def usable(vector, width: int):
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == width) & ~F.coalesce(bad, F.lit(True))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact integers, of 64 bits where they are narrow."""
    scaled = values * float(scale)  # exact for a power of two
    if not len(values) or np.abs(scaled).max(initial=0) <= NARROW:
        return np.floor(scaled).astype(np.int64)
    made = np.empty(values.shape, object)
    made.ravel()[:] = [(Fraction(x) * scale).__floor__() for x in values.ravel().tolist()]
    return made


def _narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in one type that holds squared distances between them."""
    return list(arrays) if all(a.dtype != object for a in arrays) else [a.astype(object) for a in arrays]


@dataclass(frozen=True)
class Simplex:
    """Pivots, and the lower triangular coordinates of all but the first one, which lies in the origin."""

    pivots: np.ndarray
    base: np.ndarray

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Apex coordinates from the distances to the pivots; the last one is the height over the base."""
        x = x.astype(np.float64)
        square = np.stack([((x - p) ** 2).sum(1) for p in self.pivots], 1) if len(self.pivots) else np.zeros((len(x), 1))
        right = (square[:, :1] + (self.base**2).sum(1)[None] - square[:, 1:]) / 2
        flat = right @ np.linalg.inv(self.base).T if len(self.base) else np.zeros((len(x), 0))
        return np.column_stack([flat, np.sqrt(np.maximum(square[:, 0] - (flat**2).sum(1), 0))])


def simplex(sample: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Pivots of a sample, each the one farthest from the base of those before; fewer if the rest lies in it."""
    x = sample.astype(np.float64)
    if not len(x):
        return Simplex(np.zeros((0, sample.shape[1])), np.zeros((0, 0)))
    chosen = [0]
    base = np.zeros((0, 0))
    largest = np.sqrt(((x - x[0]) ** 2).sum(1)).max()
    while len(chosen) < most and np.isfinite(largest) and largest > 0:
        apex = Simplex(x[chosen], base).apexes(x)
        best = int(apex[:, -1].argmax())
        if apex[best, -1] <= 1e-2 * largest:
            break
        grown = np.zeros((len(chosen), len(chosen)))
        grown[:-1, :-1] = base
        grown[-1] = apex[best]
        base = grown
        chosen.append(best)
    return Simplex(x[chosen], base)


def _candidates(apex: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest, by the bounds alone; rounding is allowed for."""
    size = (apex**2).sum(1)[:, None] + (centres**2).sum(1)[None]
    lower = size - 2 * apex @ centres.T
    upper = lower + 4 * apex[:, -1:] * centres[None, :, -1]
    return ~(lower > upper.min(1)[:, None] + 1e-6 * (1 + size.max(1)[:, None]))  # beyond floating point all stay


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its exact squared distance, and the exact comparisons made."""
    row, number = np.nonzero(_candidates(apex, centres))
    v, centroids = _narrow(v, centroids)
    far = np.empty(len(row), v.dtype)
    step = max(1, CELLS // max(1, v.shape[1]))
    for a in range(0, len(row), step):
        far[a : a + step] = ((v[row[a : a + step]] - centroids[number[a : a + step]]) ** 2).sum(1)
    order = np.lexsort((number, far, row)) if far.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], far[i], number[i])), np.int64)
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return number[first], far[first], len(row)


_STORED = [T.StructField("x", T.BinaryType()), T.StructField("apex", T.BinaryType())]
_SUM = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("total", T.DecimalType(38, 0)), T.StructField("n", T.LongType())])


def _blocks(batches, width: int, scale: int, dims: int):
    """(batch, integer vectors, apexes) of rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x, apex = (np.frombuffer(b"".join(part.column(i).to_pylist())).reshape(part.num_rows, n) for i, n in ((part.num_columns - 2, width), (part.num_columns - 1, dims)))
            yield part, whole(x, scale), apex


def _numbers(values: np.ndarray) -> list[int]:
    return [int(v) for v in values]


def _averages(stored: DataFrame, centroids: np.ndarray, base: Simplex, width: int, scale: int) -> np.ndarray:
    """Centroids after one round: a task sends one sum per cluster and component."""
    shared = stored.sparkSession.sparkContext.broadcast((centroids, base.apexes(centroids)))
    dims = len(base.base) + 1

    def add(batches):
        centroids, centres = shared.value
        total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, v, apex in _blocks(batches, width, scale, dims):
            cluster, _, _ = nearest(v, apex, centroids, centres)
            for c in np.unique(cluster):
                total[c] += v[cluster == c].sum(0)
                n[c] += (cluster == c).sum()
        used = np.flatnonzero(n)
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), [Decimal(int(s)) for c in used for s in total[c]], np.repeat(n[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()), strict=True)], names=_SUM.names)

    rows = stored.select("x", "apex").mapInArrow(add, _SUM).groupBy("cluster", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.astype(object)
    for r in rows:
        moved[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return _fitted(moved)


def _fitted(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) if all(abs(x) <= NARROW for x in v.ravel()) else v


def assign(data: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3", vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, stored, and the final centroids as integers.

    Vectors of `width` components, none null or non-finite, become floor(scale * x),
    scale a power of two; the others give no row. The first centroids are the k
    vectors whose `seed`:vec_id has the smallest SHA-256 (a null id counts as
    empty, equal ids go by their vectors), fewer if there are fewer vectors. Each
    round assigns all vectors to the nearest centroid, ties to the smaller number,
    and moves every centroid that has vectors to their floored mean. Distances are
    squared; one that a long can't hold fails the job, as do sums over 38 digits.
    Rows with equal vec_id count each. Only k vectors, a sample of SAMPLE rows for
    the pivots and k * width sums come to the driver.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale is a power of two")
    spark, v = data.sparkSession, F.col(vector).cast("array<double>")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    source = data.where(usable(F.col(vector), width)).select(F.col(vec_id).alias("vec_id"), v.alias("x"))
    first = source.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(max(k, SAMPLE)).select("x").collect()
    sample = np.array([r["x"] for r in first], np.float64).reshape(len(first), width)
    centroids = whole(sample[:k], scale)
    base = simplex(whole(sample, scale), pivots)
    shared = spark.sparkContext.broadcast(base)
    kept = T.StructType([source.schema["vec_id"], *_STORED])

    def project(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                apex = shared.value.apexes(whole(x, scale))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary()) for m in (x, apex))], names=kept.names)

    stored = materialise(source.mapInArrow(project, kept))
    if len(centroids):
        for _ in range(rounds):
            centroids = _averages(stored, centroids, base, width, scale)
    final = spark.sparkContext.broadcast((centroids, base.apexes(centroids) if len(centroids) else None))
    dims = len(base.base) + 1
    made = T.StructType([source.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def last(batches):
        centroids, centres = final.value
        for part, x, apex in _blocks(batches, width, scale, dims):
            if len(x):
                cluster, far, _ = nearest(x, apex, centroids, centres)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(_numbers(far), pa.int64())], names=made.names)

    return materialise(stored.mapInArrow(last, made)), centroids


def inertias(assigned: DataFrame) -> dict[int, int]:
    """The summed distance of each cluster that has vectors: k numbers."""
    return {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
