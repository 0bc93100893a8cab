"""Connected components by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundgrid.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of edges (a, b).

    Each round hangs a node's larger neighbours on its least one, then its smaller
    ones, and writes the edges to the shared folder, until no edge moves. Of a node
    with many edges only a minimum is taken, and the join that hands it to the edges
    has one row a node on its other side, so Spark may split it; nodes without an
    edge are not in the result.
    """
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        last, now = now, materialise(_star(_star(now, True), False))
        discard(last)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    parents = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return parents.union(parents.select(F.col("component").alias("node"), "component").distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: neighbours above a node go to the least of it and its neighbours; small star: those below."""
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
    if larger:
        both = both.union(edges.select(F.col("a").alias("node"), F.col("b").alias("to")))
    least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
    moved = both.join(least, "node")
    if larger:
        hung = moved.where(F.col("to") > F.col("node")).select(F.col("least").alias("a"), F.col("to").alias("b"))
    else:
        hung = moved.select(F.col("least").alias("a"), F.col("to").alias("b")).union(moved.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return hung.where(F.col("a") != F.col("b")).distinct()
