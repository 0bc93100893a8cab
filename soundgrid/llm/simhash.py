"""SimHash near-duplicates by multi-index hashing.

Distinct fingerprints are cut into two 32-bit segments. Fingerprints at up to three
differing bits differ in at most one bit of one segment, so each fingerprint probes,
per segment, the Hamming ball of radius one around its value; what the table holds
there is verified at full length. Copies collapse to one fingerprint before that.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.graph import components
from soundgrid.llm.texts import append
from soundgrid.session import materialise

SEED = 42
SEGMENT_BITS = 32
#: Fingerprints with one segment value beyond which all of them are linked through midpoints instead of pairs.
CROWD = 48


def _hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(len(words) - width + 1, 1)
    bounds = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in bounds), np.uint64, n)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; zero without words."""
    hashes = _hashes(text or "", width)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """docs with `simhash` long: bit set if in over half the hashes of its `width`-word shingles.

    A-Z is lowered, words are split at ASCII white space; fewer words than `width`
    make one shingle; a null text or one without words has fingerprint zero.
    """
    return append(docs, lambda: lambda texts: [[fingerprint(t, width) for t in texts]], [T.StructField("simhash", T.LongType())], text)


def _segment(fp, number: int):
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (1 - number)).bitwiseAND(F.lit(2**SEGMENT_BITS - 1)) + F.lit(number * 2**SEGMENT_BITS)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints `simhash` within `radius` (0 to 3) bits.

    Every linked pair is an edge, except among fingerprints that meet a crowded
    segment value: these join the least fingerprint within one bit of a common
    midpoint, which connects the same sets without a row for each pair.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of one bit are exact up to a radius of 3")
    fp = F.col("simhash")
    table = fps.select(fp.alias("b"), F.explode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    probes = fps.select(fp.alias("a"), F.explode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("own")).select("a", F.explode(F.transform(flips, lambda m: F.col("own").bitwiseXOR(m))).alias("key"))
    crowded = materialise(table.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    calm = table.join(crowded, "key", "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = probes.join(calm, "key").where((F.col("a") < F.col("b")) & (near <= radius)).select("a", "b")
    crowd = table.join(crowded, "key").select(F.col("b").alias("simhash")).union(probes.join(crowded, "key").select(F.col("a").alias("simhash"))).distinct()
    return pairs.union(_midpoints(crowd, radius)).distinct()


def _midpoints(crowd: DataFrame, radius: int) -> DataFrame:
    """Edges between each fingerprint and the least one that shares a midpoint with it.

    Two fingerprints within 2 bits share a midpoint one bit from both at most, and
    all that share one are within 2 bits. For a radius of 3 the midpoint is one bit
    from the one and two from the other; both roles are kept apart.
    """
    fp = F.col("simhash")
    ones = [F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)]]
    if radius == 0:
        return crowd.where(F.lit(False)).select(fp.alias("a"), fp.alias("b"))
    if radius == 1:
        ball = crowd.select(fp, F.explode(F.transform(F.array(*ones), lambda m: fp.bitwiseXOR(m))).alias("mid"))
        hit = ball.join(crowd.select(fp.alias("b")), F.col("mid") == F.col("b")).where(fp < F.col("b"))
        return hit.select(fp.alias("a"), "b")
    ball = crowd.select(fp, F.explode(F.transform(F.array(*ones), lambda m: fp.bitwiseXOR(m))).alias("mid"))
    least = ball.groupBy("mid").agg(F.min("simhash").alias("a"))
    if radius == 3:
        ball = ball.select("simhash", F.explode(F.transform(F.array(*ones), lambda m: F.col("mid").bitwiseXOR(m))).alias("mid")).distinct()
    edges = ball.join(least, "mid").where(F.col("a") != fp)
    return edges.select(F.least("a", fp).alias("a"), F.greatest("a", fp).alias("b")).distinct()


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """(simhash, least, n, component) of each distinct fingerprint of rows (doc_id, simhash); component names its set of linked fingerprints."""
    groups = materialise(rows.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    member = components(links(groups, radius))
    return materialise(groups.join(member, groups["simhash"] == member["node"], "left").select("simhash", "least", "n", F.coalesce("component", "simhash").alias("component")))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, simhash, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius`
    differing bits, itself included. Rows without a doc_id keep their place in the
    links but never name a component; where all of one have none, it is null.
    Repeated rows stay; an empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width).select("doc_id", "simhash"))
    labelled = _labelled(rows, radius)
    named = labelled.join(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("simhash", "component_id", "n")
    return spread(rows, named, "simhash")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each set of near-duplicates: the smallest (doc_id, digest of the text), ids before nulls.

    Rows that repeat whole count as one. All columns stay; see near_duplicates().
    """
    key = [F.xxhash64(F.col(doc_id), F.col(text)).alias("__k1"), F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text)).alias("__k2")]
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *key)
    rows = materialise(fingerprints(slim, width).select("doc_id", "simhash", "__k1", "__k2"))
    labelled = _labelled(rows, radius)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__k1", "__k2")
    first = rows.groupBy("simhash").agg(F.min(order).alias("first"))
    chosen = first.join(labelled.select("simhash", "component"), "simhash").groupBy("component").agg(F.min("first").alias("first")).select("first.__k1", "first.__k2")
    return docs.select("*", *key).join(chosen, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select(*docs.columns)


def spread(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with the one row of groups for their key; n in groups counts the key's rows.

    Keys with over a thousandth of all rows, a thousand at most, are broadcast; the rest is joined by key.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * 1000 > total
    large = F.broadcast(groups.where(heavy).drop("n"))
    small = groups.where(~heavy).drop("n")
    names = large.columns
    marked = rows.join(large.withColumnsRenamed({c: f"__{c}" for c in names}), F.col(key) == F.col(f"__{key}"), "left")
    hot = marked.where(F.col(f"__{key}").isNotNull()).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in names if c != key])
    cold = marked.where(F.col(f"__{key}").isNull()).select(*rows.columns).join(small, key)
    return hot.select(*rows.columns, *[c for c in names if c != key]).union(cold.select(*rows.columns, *[c for c in names if c != key]))
