"""Sharding by a minimax contiguous partition, with DataFrame functions only."""
from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundgrid.session import materialise

#: Running sums go in two levels over so many fixed ranges of the group name.
BUCKETS = 4096
#: Capacities tested by one pass of the search; each pass narrows the range so many times.
PROBES = 63
#: Row numbers inside a shard go in two levels over so many parts.
PARTS = 256


def _sizes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.md5(content).alias("group"))


def _running(groups: DataFrame) -> DataFrame:
    """Groups with `upto`, the sum of sizes up to and with each, in order of their name."""
    bucket = F.conv(F.substring("group", 1, 3), 16, 10).cast("int")
    groups = groups.withColumn("bucket", bucket)
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes"))  # at most BUCKETS rows
    base = totals.select("bucket", (F.sum("bytes").over(Window.orderBy("bucket")) - F.col("bytes")).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("group")
    return groups.withColumn("inside", F.sum("bytes").over(inside)).join(base, "bucket").select("group", "bucket", "bytes", (F.col("base") + F.col("inside")).alias("upto"))


def _next_cuts(running: DataFrame, buckets: list[tuple[int, int]], start: list[int], capacity: list[int]) -> list[int]:
    """For each capacity, the end of the last group that a shard from `start` can still hold.

    buckets: (first byte, bucket) in order. A target's bucket holds the wanted end,
    or else the end is where that bucket begins.
    """
    first = [b for b, _ in buckets]
    ends = [s + c for s, c in zip(start, capacity, strict=True)]
    homes = [bisect.bisect_right(first, e) - 1 for e in ends]
    wanted = ", ".join(f"({i}, {buckets[h][1]}, {e}L)" for i, (h, e) in enumerate(zip(homes, ends, strict=True)))
    targets = running.sparkSession.sql(f"SELECT * FROM VALUES {wanted} AS t(i, bucket, target)")  # PROBES + 1 rows at most
    found = running.select("bucket", "upto").join(F.broadcast(targets), "bucket").where(F.col("upto") <= F.col("target")).groupBy("i").agg(F.max("upto").alias("upto")).collect()
    inside = {r["i"]: r["upto"] for r in found}
    return [max(s, inside.get(i, first[h])) for i, (s, h) in enumerate(zip(start, homes, strict=True))]


def cuts(running: DataFrame, shards: int) -> list[int]:
    """Ends of the shards (but the last) under the smallest feasible capacity.

    Every pass tests PROBES capacities at once; each is checked greedily, shard by
    shard. The driver holds one number per bucket, and per capacity and shard.
    """
    ranges = sorted((r["begin"], r["bucket"], r["size"], r["largest"]) for r in running.groupBy("bucket").agg(F.min(F.col("upto") - F.col("bytes")).alias("begin"), F.sum("bytes").alias("size"), F.max("bytes").alias("largest")).collect())
    if not ranges:
        return []
    buckets, total, largest = [(r[0], r[1]) for r in ranges], sum(r[2] for r in ranges), max(r[3] for r in ranges)
    low = max(-(-total // shards), largest)
    high = max(low, -(-total // shards) + largest)  # always feasible: a shard is only closed when the next group doesn't fit
    best: dict[int, list[int]] = {}
    while high not in best or low < high:
        step = -(-(high - low + 1) // PROBES)
        tried = sorted({*range(low, high, step), high})
        at = [[0] * len(tried)]
        for _ in range(shards - 1):
            at.append(_next_cuts(running, buckets, at[-1], tried))
        fits = [total - at[-1][i] <= c for i, c in enumerate(tried)]
        first = fits.index(True)
        best = {tried[first]: [row[first] for row in at[1:]]}
        high = tried[first]
        low = tried[first - 1] + 1 if first else high
    return best[high]


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    Rows of equal text form one atomic group; groups stand in order of a digest of
    their text, which fixes the order whatever the partitioning. The order is cut
    into `shards` runs so that the largest run's bytes are as few as possible. size
    is the text's UTF-8 bytes plus 1; a null text has none and belongs to the empty
    ones. slot counts the rows of a shard from 0 without gaps. With fewer groups
    than shards some shards stay empty; an empty table gives an empty result;
    other columns are ignored, repeated rows keep a row each.
    """
    rows = materialise(_sizes(docs, doc_id, text))
    running = materialise(_running(rows.groupBy("group").agg(F.sum("size").alias("bytes"))))
    ends = cuts(running, shards)
    named = {r["upto"]: r["group"] for r in running.where(F.col("upto").isin(ends)).select("upto", "group").collect()} if ends else {}
    shard = F.lit(0)
    for end in ends:
        shard = shard + (F.col("group") > F.lit(named.get(end, ""))).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), F.lit(PARTS)).cast("int"))
    counts = placed.groupBy("shard", "part").count()  # at most shards x PARTS rows
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group"))
    return placed.withColumn("number", number).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))
