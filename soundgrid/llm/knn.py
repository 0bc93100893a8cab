"""Exact top-k search by a Voronoi join.

Queries and data fall to their nearest pivot. Summaries of the cells give, for each
query cell, a floor under its k-th best score, and a ceiling over what a data row
can reach there; rows under the floor are not sent. Query cells are packed into
blocks of bounded size, the data sent to a block into chunks, and each tile of a
block and a chunk is solved by one matrix product.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.session import materialise

PIVOTS = 64
#: Rows of a tile: queries of a block and data rows of a chunk, about.
BLOCK_QUERIES, CHUNK_ROWS = 512, 4096


def quantised(vector) -> F.Column:
    """floor(256 * x) of every component, as a long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256).cast("long"))


def usable(vector) -> F.Column:
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blobs(vectors, width: int) -> list[bytes]:
    """Rows of integers in four bytes each, or eight where a row needs them."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    short = ((out >= -(2**31)) & (out < 2**31)).all(1)
    return [(r.astype(np.int32) if s else r).tobytes() for r, s in zip(out, short, strict=True)]


def _unblobbed(blobs, width: int) -> np.ndarray:
    if all(len(b) == 4 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), width).astype(np.int64)
    return np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * width else np.int64).astype(np.int64) for b in blobs])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


_SUMMARY = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.DoubleType())])
COUNT, RADIUS, NORM, NEAREST, DATA = 0, 1, 2, 3, 4


def _summaries(base: DataFrame, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """Per cell: queries, their radius and largest norm; the data's k + 1 smallest distances; data rows. PIVOTS * (k + 5) rows at most."""
    shared, width, cells = base.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1], len(pivots)

    def summarise(frames):
        count, radius, norm, data = np.zeros(cells), np.zeros(cells), np.zeros(cells), np.zeros(cells)
        nearest = [np.zeros(0) for _ in range(cells)]
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["v"], width)
            d = _distances(x, shared.value)
            cell, away, query = d.argmin(1), d.min(1), f["is_query"].to_numpy(bool)
            np.add.at(count, cell[query], 1)
            np.add.at(data, cell, 1)
            np.maximum.at(radius, cell[query], away[query])
            np.maximum.at(norm, cell[query], np.sqrt((x[query] ** 2).sum(1)))
            for c in np.unique(cell):
                nearest[c] = np.sort(np.append(nearest[c], away[cell == c]))[: k + 1]
        rows = [(c, kind, float(v[c])) for kind, v in ((COUNT, count), (RADIUS, radius), (NORM, norm), (DATA, data)) for c in range(cells)]
        yield pd.DataFrame(rows + [(c, NEAREST, float(v)) for c in range(cells) for v in nearest[c]], columns=["cell", "kind", "value"])

    rows = base.mapInPandas(summarise, _SUMMARY)
    summed = rows.where(F.col("kind").isin(COUNT, DATA)).groupBy("cell", "kind").agg(F.sum("value").alias("value"))
    largest = rows.where(F.col("kind").isin(RADIUS, NORM)).groupBy("cell", "kind").agg(F.max("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("value"))
    nearest = rows.where(F.col("kind") == NEAREST).withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    return materialise(summed.union(largest).union(nearest)).toPandas()


def _plan(s: pd.DataFrame, pivots: np.ndarray, k: int) -> dict:
    """Floors of the query cells, and their packing into blocks."""
    cells = len(pivots)
    of = lambda kind: s[s["kind"] == kind].set_index("cell")["value"].reindex(range(cells)).fillna(0).to_numpy()
    count, radius, norm = of(COUNT).astype(np.int64), of(RADIUS), of(NORM)
    near = s[s["kind"] == NEAREST]
    home, away = near["cell"].to_numpy(int), near["value"].to_numpy()
    size = np.sqrt((pivots**2).sum(1))
    floor = np.full(cells, -np.inf)
    for i in np.flatnonzero(count):
        least = pivots[i] @ pivots[home].T - radius[i] * size[home] - away * size[i] - radius[i] * away
        if len(least) > k:  # one of them may be the query itself
            floor[i] = np.sort(least)[-(k + 1)]
    blocks: list[list[int]] = []
    split = np.maximum(1, -(-count // BLOCK_QUERIES))
    first, room = np.zeros(cells, np.int64), 0
    for i in np.flatnonzero(count):
        if split[i] > 1:
            first[i] = len(blocks)
            blocks += [[i]] * int(split[i])
            room = 0
        else:
            if room < count[i]:
                blocks.append([])
                room = BLOCK_QUERIES
            blocks[-1].append(i)
            first[i], room = len(blocks) - 1, room - int(count[i])
    return {"radius": radius, "norm": norm, "floor": floor, "first": first, "split": split, "blocks": blocks, "chunks": max(1, int(-(-of(DATA).sum() // CHUNK_ROWS)))}


def _route(base: DataFrame, pivots: np.ndarray, plan: dict) -> DataFrame:
    """Rows by (block, chunk): each query once per chunk of its block, each data row once per block that may need it."""
    shared, width = base.sparkSession.sparkContext.broadcast((pivots, plan)), pivots.shape[1]
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("is_query", T.BooleanType()), T.StructField("vec_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("v", T.BinaryType())])

    def route(frames):
        pivots, p = shared.value
        chunks = p["chunks"]
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["v"], width)
            ids, query = f["vec_id"].to_numpy(np.int64), f["is_query"].to_numpy(bool)
            spread = f["spread"].to_numpy(np.int64)
            rows, packed = f["row"].to_numpy(np.int64), _blobs(f["v"], width)
            d = _distances(x, pivots)
            square, size, inner = (x**2).sum(1), np.sqrt((x**2).sum(1)), x @ pivots.T
            block, chunk, kind, row = [], [], [], []
            home = d.argmin(1)
            mine = np.flatnonzero(query)
            b = p["first"][home[mine]] + spread[mine] // chunks % p["split"][home[mine]]
            block.append(np.repeat(b, chunks))
            chunk.append(np.tile(np.arange(chunks), len(mine)))
            row.append(np.repeat(mine, chunks))
            kind.append(np.ones(len(mine) * chunks, bool))
            slack = 1e-6 * (1 + size[:, None] * p["norm"][None])
            ceiling = np.minimum(size[:, None] * p["norm"][None], inner + p["radius"][None] * size[:, None])
            ceiling = np.minimum(ceiling, (square[:, None] + p["norm"][None] ** 2 - np.maximum(d - p["radius"][None], 0) ** 2) / 2) + slack
            needed = ceiling >= p["floor"][None]
            for number, cells in enumerate(p["blocks"]):
                at = np.flatnonzero(needed[:, cells].any(1))
                block.append(np.full(len(at), number))
                chunk.append(spread[at] % chunks)
                row.append(at)
                kind.append(np.zeros(len(at), bool))
            block, chunk, row, kind = (np.concatenate(v) for v in (block, chunk, row, kind))
            for a in range(0, len(row), 20_000):
                r = row[a : a + 20_000]
                yield pd.DataFrame({"block": block[a : a + 20_000].astype(np.int32), "chunk": chunk[a : a + 20_000].astype(np.int32), "is_query": kind[a : a + 20_000], "vec_id": ids[r], "row": rows[r], "v": [packed[i] for i in r]})

    return base.mapInPandas(route, schema)


_TOP = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _solver(k: int, width: int):
    def solve(tile: pd.DataFrame) -> pd.DataFrame:
        ids, own, query = tile["vec_id"].to_numpy(np.int64), tile["row"].to_numpy(np.int64), tile["is_query"].to_numpy(bool)
        x = _unblobbed(list(tile["v"]), width)
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        data = order[~query[order]]
        asked = np.flatnonzero(query)
        rows = [(np.zeros(0, np.int64),) * 4]
        if len(asked) and len(data):
            most = int(np.abs(x.astype(float)).max()) ** 2 * width
            exact = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object  # Python's integers; a score over 64 bits fails
            scores = x[asked].astype(exact) @ x[data].astype(exact).T
            scores = scores if exact is object else scores.astype(np.int64)
            for at, score in zip(asked, scores, strict=True):
                other = own[data] != own[at]
                score, mine = score[other], ids[data][other]
                keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
                keep = keep[np.argsort(-score[keep], kind="stable")][:k]
                rows.append((np.full(len(keep), own[at]), np.full(len(keep), ids[at]), mine[keep], score[keep].astype(np.int64)))
        return pd.DataFrame(dict(zip(_TOP.names, (np.concatenate(c) for c in zip(*rows, strict=True)), strict=True)))

    return solve


def top_k(data: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the condition is_query(vec_id) holds, the k rows with the highest inner product.

    Components are quantised to floor(256 * x) and scored exactly; a score that a
    long can't hold fails the job. Vectors that are null or hold null or non-finite
    components, and rows without a vec_id, take no part. Ties go to the smaller
    vec_id. Rows that share a vec_id are rows each: as queries they have a result
    each, and they are candidates of each other. Shorter vectors count as ended by
    zeros; empty vectors score zero. Queries without another row give no row; other
    columns are ignored.
    """
    ident, v = F.col(vec_id).cast("long"), F.col(vector)
    rows = data.where(usable(v) & ident.isNotNull()).select(ident.alias("vec_id"), quantised(v).alias("v"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # kept by the table
    base = materialise(rows.select("vec_id", "row", "v", F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("is_query"), F.shiftrightunsigned(F.xxhash64("vec_id", "row"), 1).alias("spread")))
    width = base.agg(F.max(F.size("v"))).first()[0] or 0
    chosen = base.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(pivots).select("v").collect()
    if not chosen:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    width = max(width, 1)
    centres = _matrix([r["v"] for r in chosen], width)
    plan = _plan(_summaries(base, centres, k), centres, k)
    tiles = _route(base, centres, plan)
    tops = tiles.groupBy("block", "chunk").applyInPandas(_solver(k, width), _TOP)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
