"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shard files.

Token ids are cut into sequences of fixed length. A keyed Feistel permutation with
cycle-walking gives every sequence a slot; tasks write ranges of slots as files in
which the record of a slot stands at a computed offset.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.store import Store, new_folder, packed, unpacked
from soundgrid.session import materialise

LENGTH, RECORDS, ROUNDS = 512, 8192, 6


def feistel(index: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index, a permutation of 0 to count - 1 that depends on key alone.

    A balanced Feistel network permutes the next larger even power of two; values
    outside are walked on until they fall inside.
    """
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            mix = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mix = (mix ^ (mix >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mix >> np.uint64(29)) & mask)
        return (left << half) | right

    slot = once(index.astype(np.uint64))
    while len(out := np.flatnonzero(slot >= np.uint64(count))):
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def byte_ids(text) -> F.Column:
    """A text's UTF-8 bytes as token ids of one byte each; 255 never occurs in UTF-8 and serves as padding."""
    return F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")


def wide_ids(ids) -> F.Column:
    """An array of ids below 65535 as little-endian ids of two bytes each."""
    pairs = F.transform(ids, lambda i: F.concat(F.lpad(F.hex(i.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(i, 8)), 2, "0")))
    return F.unhex(F.array_join(pairs, ""))


_INDEX = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("seq_no", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("record_crc32", T.LongType())])


def materialise_order(docs: DataFrame, ids, key: int = 1, length: int = LENGTH, width: int = 1, records: int = RECORDS, doc_id: str = "doc_id", folder: str | None = None, eager: bool = True) -> tuple[DataFrame, str]:
    """The index of the shard files, and their folder; the files are written as the index is computed.

    ids: a binary column with a document's token ids, `width` bytes each, see
    byte_ids() and wide_ids(). The index has a row per sequence: slot (0 to
    count - 1, each once), shard (slot div records), byte offset of the record in
    the shard's file, doc_id, seq_no within the document, tokens before the
    padding, CRC-32 of the record. A record is `length` ids, padded by bytes of
    255. Null or empty ids are one sequence of padding; repeated rows are written
    each; other columns are ignored.

    Sequences are numbered by the partitions of docs, which must be a plain scan of
    files: a first pass counts each partition, and the second stops with an error
    if it finds another number. Files are put in place in one step, so tasks may
    run again, and a reader needs only the manifest to resume at any slot. Without
    `eager` the files are there once the index has been read through.
    """
    spark, stride = docs.sparkSession, length * width
    folder = folder or new_folder(spark, "order")
    store = Store(folder)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(ids, F.lit(b"")).alias("ids"))
    sequences = F.greatest(F.lit(1), F.ceil(F.octet_length("ids") / stride)).cast("long")
    tasks = sorted((r["task"], r["n"]) for r in source.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(sequences).alias("n")).collect())  # one number per partition
    count = sum(n for _, n in tasks)
    first = np.append(0, np.cumsum([n for _, n in tasks], dtype=np.int64))[:-1].tolist()
    plan = {t: (a, n) for (t, n), a in zip(tasks, first, strict=True)}
    store.write("manifest.json", json.dumps({"count": count, "length": length, "width": width, "stride": stride, "records": records, "key": key}).encode())
    shared = spark.sparkContext.broadcast(plan)
    dealt = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("records", T.BinaryType())])

    def deal(batches):
        """Records by shard, packed: many short rows of text would travel at half the compression."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        start, expected = shared.value.get(task, (0, 0))
        done = 0
        for batch in batches:
            data = batch.column(1).to_pylist()
            seqs = np.maximum(1, -(-np.fromiter(map(len, data), np.int64, len(data)) // stride))
            doc = np.repeat(np.arange(len(data)), seqs)
            number = np.arange(seqs.sum()) - np.repeat(np.cumsum(seqs) - seqs, seqs)
            slot = feistel(start + done + np.arange(seqs.sum()), count, key)
            done += int(seqs.sum())
            names, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.diff(slot[order] // records)) + 1
            for at in np.split(order, cuts) if len(order) else ():
                parts = [data[d][i * stride : (i + 1) * stride] for d, i in zip(doc[at].tolist(), number[at].tolist(), strict=True)]
                lengths = np.fromiter(map(len, parts), np.int32, len(parts))
                blob = packed(slot[at], names[doc[at]], known[doc[at]], number[at].astype(np.int32), lengths, np.frombuffer(b"".join(parts), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([int(slot[at[0]] // records)], pa.int32()), pa.array([blob], pa.binary())], names=dealt.names)
        if done != expected:
            raise RuntimeError(f"partition {task} has {done} sequences, {expected} were counted: docs is no stable scan of files")

    def put(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        """Writes one shard's records in the order of their slots; returns its part of the index."""
        from zlib import crc32

        from pyspark.sql.pandas.types import to_arrow_schema

        slot, name, known, number, lengths, data = (np.concatenate(x) for x in zip(*(unpacked(b, 6) for b in blobs), strict=True))
        place = slot - shard * records
        whole = np.full((len(slot), stride), 255, np.uint8)
        within = np.arange(len(data)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
        whole[np.repeat(place, lengths), within] = data
        body = whole.tobytes()
        store.write(f"shard-{shard:06d}.bin", body)
        sums = np.fromiter((crc32(body[i : i + stride]) for i in range(0, len(body), stride)), np.int64, len(slot))
        columns = [slot, np.full(len(slot), shard), place * stride, pa.array(name, mask=~known), number, lengths // width, sums[place]]
        arrow = to_arrow_schema(_INDEX)
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def write(batches):
        shard, blobs = None, []
        for batch in batches:
            for s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and blobs:
                    yield put(shard, blobs)
                    blobs = []
                shard = s
                blobs.append(blob)
        if blobs:
            yield put(shard, blobs)

    index = source.mapInArrow(deal, dealt).repartition("shard").sortWithinPartitions("shard").mapInArrow(write, _INDEX)
    return (materialise(index) if eager else index), folder


def read_slots(folder: str, start: int, count: int) -> np.ndarray:
    """Records of the slots [start, start + count), one row each, read sequentially from the shard files."""
    store = Store(folder)
    with open(store.path("manifest.json")) as f:
        spec = json.load(f)
    kind = f"<u{spec['width']}"
    end, out = min(start + count, spec["count"]), []
    while start < end:
        shard, at = divmod(start, spec["records"])
        n = min(end - start, spec["records"] - at)
        out.append(np.memmap(store.path(f"shard-{shard:06d}.bin"), kind, "r", at * spec["stride"], (n, spec["length"])))
        start += n
    return np.concatenate(out) if out else np.zeros((0, spec["length"]), kind)
