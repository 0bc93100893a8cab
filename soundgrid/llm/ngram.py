"""Interpolated modified Kneser-Ney model of any order from two on, counted in Spark.

The highest order has counts of n-grams, each lower one counts of distinct words
before. Frequent words have short codes, so that an n-gram of such words is one
64-bit key; the others travel as hashes. Counts of n-grams travel as sorted blocks by
shard of the context's hash and are merged per shard, order by order; the merged
shards are stored as sorted hash arrays in the shared folder. Workers map these
arrays into memory and score texts by binary search, so no worker ever holds the model.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.store import Store, new_folder, packed, planes, unpacked, unplanes
from soundgrid.llm.texts import append, slices
from soundgrid.session import discard, materialise

BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens that a counting task holds before it passes their n-grams on.
FLUSH_TOKENS = 3_000_000
#: Bytes of training text per shard of the model, and bits of a shard's number at most.
SHARD_BYTES, SHARD_BITS = 12 << 20, 20
#: Words with over a thousandth of the tokens (of one document in SAMPLE) have their n-grams dealt out over all shards.
HOT_SHARE, SAMPLE = 1000, 64
#: Bits of a short code at most; documents of which the coded words are taken are one in CODE_SAMPLE.
CODE_BITS, CODE_SAMPLE = 18, 16
#: Hashes from here on are hashes, numbers below are short codes.
WIDE = np.uint64(1 << 32)

_PART = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.BinaryType())])


class WordHashes(dict):
    """XXH64 of words, or their short codes where there are such; forgets all when it has grown too large."""

    def __init__(self, codes: dict[int, int] | None = None, end=END):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.codes, self.end, self.hash = codes, end, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        value = value if value >> 32 else value | 1 << 40
        self[word] = value = self.codes.get(value, value) if self.codes else value
        return value

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens in a row (each text's words, then the end), and the tokens of each text."""
        if len(self) > 400_000:
            self.clear()
        words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        counts = np.array([len(w) + 1 for w in words], np.int64)
        out = np.full(counts.sum(), self.end, np.uint64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.uint64, len(out) - len(words))
        return out, counts


def before(tokens: np.ndarray, counts: np.ndarray, order: int, begin=BEGIN) -> list[np.ndarray]:
    """The tokens order - 1 to one places before each token; `begin` stands before a text."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for back in range(order - 1, 0, -1):
        there = np.full_like(tokens, begin)
        there[back:] = tokens[:-back]
        there[place < back] = begin
        out.append(there)
    return out


def context(words: list[np.ndarray]) -> np.ndarray:
    """The hash of the words of a context, the nearest one last."""
    out = words[-1]
    for w in reversed(words[:-1]):
        out = mixed(w, out)
    return out


def contexts(tokens: np.ndarray, counts: np.ndarray, order: int = 2) -> list[np.ndarray]:
    """Hashes of the order - 1 tokens before each token, of the order - 2 before it, and so on to the one before."""
    words = before(tokens, counts, order)
    return [context(words[i:]) for i in range(order - 1)]


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = context * np.uint64(0xBF58476D1CE4E5B9) + (word ^ (word >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shards_of(context: np.ndarray, pair: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Shard: the top bits of the context's hash, or of the pair's for a hot context."""
    spread = np.isin(context, hot) if len(hot) else np.zeros(len(context), bool)
    return (np.where(spread, pair, context) >> np.uint64(64 - bits)).astype(np.int32)


def pair_keys(shard: np.ndarray, pair: np.ndarray, bits: int) -> np.ndarray:
    """Keys that sort by shard first."""
    return (shard.astype(np.uint64) << np.uint64(64 - bits)) | (pair >> np.uint64(bits))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@dataclass
class Plan:
    """What all counting and merging tasks share: the shards, hot contexts, and the hashes of the coded words by code (0: begin, 1: end)."""

    order: int
    bits: int
    hot: np.ndarray
    words: np.ndarray

    def code_bits(self, width: int) -> int:
        return min(CODE_BITS, 64 // width)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Hashes of codes and hashes."""
        return np.where(words < WIDE, self.words[np.where(words < WIDE, words, 0).astype(np.int64)], words)

    def narrow(self, columns: list[np.ndarray]) -> np.ndarray:
        limit = np.uint64(1 << self.code_bits(len(columns)))
        out = columns[0] < limit
        for c in columns[1:]:
            out &= c < limit
        return out

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        step, out = np.uint64(self.code_bits(len(columns))), columns[0].copy()
        for c in columns[1:]:
            out = (out << step) | c
        return out

    def columns(self, keys: np.ndarray, width: int) -> list[np.ndarray]:
        bits = self.code_bits(width)
        mask = np.uint64((1 << bits) - 1)
        return [(keys >> np.uint64(bits * i)) & mask for i in range(width - 1, -1, -1)]

    def summed(self, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Distinct rows of words, those that fit one key first, each kind sorted, and their summed values."""
        fits, parts = self.narrow(columns), []
        inner = np.flatnonzero(fits)
        keys = self.keys([c[inner] for c in columns])
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        parts.append((inner[order], at))
        outer = np.flatnonzero(~fits)
        order = outer[np.lexsort([c[outer] for c in reversed(columns)])]
        parts.append((order, runs(*[c[order] for c in columns])))
        rows = np.concatenate([o[a] for o, a in parts])
        sums = [np.concatenate([np.add.reduceat(v[o], a) if len(a) else v[:0] for o, a in parts]) for v in values]
        return [c[rows] for c in columns], sums

    def pack(self, columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
        """Rows as summed() leaves them: differences of keys, whole hashes for the others, and small values."""
        fits = self.narrow(columns)
        n = int(fits.sum())  # these come first
        keys = self.keys([c[:n] for c in columns])
        small = [v.astype(np.min_scalar_type(v.max(initial=0))) for v in values]
        return packed(planes(np.diff(keys, prepend=np.uint64(0))), *(planes(c[n:]) for c in columns), *small)

    def unpack(self, data: bytes, width: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        steps, *rest = unpacked(data, 1 + width + values)
        inner = self.columns(np.cumsum(unplanes(steps, np.uint64), dtype=np.uint64), width)
        return [np.concatenate([a, unplanes(b, np.uint64)]) for a, b in zip(inner, rest[:width], strict=True)], [v.astype(np.int64) for v in rest[width:]]

    def packs(self, columns: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[int, bytes]]:
        """(shard, block) of rows as summed() leaves them: the shard of an n-gram is its context's, that of a single word its own."""
        hashes = [self.hashes(c) for c in columns]
        if len(columns) > 1:
            c = context(hashes[:-1])
            shard = shards_of(c, mixed(c, hashes[-1]), self.bits, self.hot)
        else:
            shard = (hashes[0] >> np.uint64(64 - self.bits)).astype(np.int32)
        order = np.argsort(shard.astype(np.uint16) if self.bits <= 16 else shard, kind="stable")
        at, out = runs(shard[order]), []
        for a, b in zip(at, np.append(at[1:], len(shard)), strict=True):
            rows = order[a:b]
            out.append((int(shard[rows[0]]), self.pack([x[rows] for x in columns], [x[rows] for x in values])))
        return out


def _count(batches, plan: Plan):
    """Blocks of the highest order's n-gram counts by shard."""
    import pyarrow.compute as pc

    hashes, held, size = WordHashes({int(h): i for i, h in enumerate(plan.words.tolist()) if i > 1}, np.uint64(1)), [], 0

    def flush():
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        columns, (counts,) = plan.summed(columns, [np.ones(len(columns[0]), np.uint32)])
        shard, parts = zip(*plan.packs(columns, [counts]), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(parts, pa.binary())], names=["shard", "data"])

    for batch in batches:
        texts = batch.column(0)
        for start, count in slices(pc.binary_length(texts).to_pylist()):
            tokens, counts = hashes.of(texts.slice(start, count).to_pylist())
            held.append((*before(tokens, counts, plan.order, np.uint64(0)), tokens))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield from flush()
                size = 0
    yield from flush()


def _tally(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and how many there are; their sum."""
    return np.array([*((counts == i).sum() for i in (1, 2, 3, 4)), len(counts), counts.sum()], np.int64)


def _grouped(context: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct contexts, sorted, and their summed values."""
    order = np.argsort(context, kind="stable")
    at = runs(context[order])
    return [context[order][at], *(np.add.reduceat(v[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for v in values)]


def table(keys: np.ndarray, bits: int, **whole: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys of one shard as a directory of their next bits and 32 bits each, and whole values of them."""
    depth = max(1, len(keys).bit_length() - 2)
    rest = keys << np.uint64(bits)
    out = {"starts": np.searchsorted(rest >> np.uint64(64 - depth), np.arange((1 << depth) + 1, dtype=np.uint64)).astype(np.uint32), "keys": ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)}
    return out | {name: v.astype(np.min_scalar_type(v.max(initial=0))) for name, v in whole.items()}


def small(count: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte each, the few larger ones apart."""
    large = np.flatnonzero(count >= 255)
    return {"count": np.minimum(count, 255).astype(np.uint8), "count-at": large.astype(np.uint32), "count-is": count[large].astype(np.int64)}


def found(t: dict[str, np.ndarray], keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shard's keys are in a table(), and where."""
    depth = (len(t["starts"]) - 1).bit_length() - 1
    rest = keys << np.uint64(bits)
    bucket = (rest >> np.uint64(64 - depth)).astype(np.int64)
    low, end = t["starts"][bucket].astype(np.int64), t["starts"][bucket + 1].astype(np.int64)
    want, high, size = ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32), end.copy(), len(t["keys"])
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (t["keys"][np.minimum(middle, size - 1)] < want)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    hit = np.flatnonzero(low < end)
    hit = hit[t["keys"][low[hit]] == want[hit]]
    return hit, low[hit]


def unsmall(t: dict[str, np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    out = t["count"][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = t["count-is"][np.searchsorted(t["count-at"], at[large])]
    return [out]


def brief(total: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray) -> dict[str, np.ndarray]:
    """What a context's n-grams add up to: one byte for few n-grams of counts one and two, else 255 and four numbers apart."""
    plain = (more == 0) & (ones < 16) & (twos < 15)
    large = np.flatnonzero(~plain)
    return {"brief": np.where(plain, ones + 16 * twos, 255).astype(np.uint8), "brief-at": large.astype(np.uint32)} | {f"brief-{i}": x[large].astype(np.int64) for i, x in enumerate((total, ones, twos, more))}


def unbrief(t: dict[str, np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    code = t["brief"][at].astype(np.int64)
    ones, twos = code & 15, code >> 4
    out = [ones + 2 * twos, ones, twos, np.zeros(len(at), np.int64)]
    large = np.flatnonzero(code == 255)
    where = np.searchsorted(t["brief-at"], at[large])
    for i, x in enumerate(out):
        x[large] = t[f"brief-{i}"][where]
    return out


def _merge(parts: list[bytes], shard: int, level: int, plan: Plan, store: Store) -> list[tuple[int, bytes]]:
    """One shard's n-grams of an order: stores their counts and contexts; returns blocks (shard, data) for the order below, and at -level the order's tally and what its hot contexts add up to."""
    top = level == plan.order
    pieces = [plan.unpack(p, level, 1 if top else 2) for p in parts]
    columns = [np.concatenate(x) for x in zip(*(p[0] for p in pieces), strict=True)]
    values = [np.concatenate(x) for x in zip(*(p[1] for p in pieces), strict=True)]
    columns, sums = plan.summed(columns, values)
    count, total = sums[0], sums[-1]
    hashes = [plan.hashes(c) for c in columns]
    c = context(hashes[:-1])
    keys = pair_keys(np.full(len(c), shard), mixed(c, hashes[-1]), plan.bits)
    order = np.argsort(keys, kind="stable")
    store.save_all(f"pairs-{level}-{shard}", table(keys[order], plan.bits) | small(count[order]))
    stats = _grouped(c, [count, count == 1, count == 2, count > 2])
    spread = np.isin(stats[0], plan.hot)
    store.save_all(f"contexts-{level}-{shard}", table(stats[0][~spread], plan.bits) | brief(*(x[~spread] for x in stats[1:])))
    tail = [(-level, packed(*(x[spread] for x in stats), _tally(count)))]
    columns, sums = plan.summed(columns[1:], [np.ones(len(c), np.int64), total])
    return plan.packs(columns, sums) + tail


def _merge_words(parts: list[bytes], shard: int, plan: Plan, store: Store) -> np.ndarray:
    pieces = [plan.unpack(p, 1, 2) for p in parts]
    columns, (kinds, total) = plan.summed([np.concatenate([p[0][0] for p in pieces])], [np.concatenate([p[1][i] for p in pieces]) for i in (0, 1)])
    word = plan.hashes(columns[0])
    order = np.argsort(word, kind="stable")
    store.save_all(f"words-{shard}", table(word[order], plan.bits, kinds=kinds[order], uses=total[order]))
    return np.append(_tally(kinds), total.sum())


@dataclass
class Model:
    """What a scorer needs beside the array files: discounts and totals, and the few hot contexts, by order."""

    folder: str
    bits: int
    hot: np.ndarray
    order: int
    hot_stats: dict[int, list[np.ndarray]]
    pair_discounts: dict[int, np.ndarray]
    word_discounts: np.ndarray
    word_tally: np.ndarray
    words: int
    tokens: int


def discounts(tally: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more, from the counts of counts; half steps where these are missing or leave a count undiscounted."""
    n = tally[:4].astype(float)
    if (n <= 0).any():
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0, *found] if min(found) > 0 else [0, 0.5, 1.0, 1.5])


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts the texts of docs and stores a model of n-grams of `order` words in the shared folder.

    Tokens are words between ASCII white space, A-Z lowered, then one end. The
    number of shards follows the bytes of text, so a shard stays small at any size.
    An empty table gives a model that finds everything equally unlikely.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max((size // SHARD_BYTES).bit_length(), 3), SHARD_BITS)
    hot = _hot_contexts(texts, order)
    folder = new_folder(spark, "ngram")
    store = Store(folder)
    shared = spark.sparkContext.broadcast(Plan(order, bits, hot, _coded_words(texts, order)))

    def count(batches):
        return _count(batches, shared.value)

    def merging(level: int):
        def pairs(key, group: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            if shard < 0:
                return pd.DataFrame([(shard, _added(list(group["data"])))], columns=["shard", "data"])
            return pd.DataFrame(_merge(list(group["data"]), shard, level, shared.value, store), columns=["shard", "data"])

        return pairs

    def words(key, group: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        if shard < 0:
            return pd.DataFrame([(shard, _added(list(group["data"])))], columns=["shard", "data"])
        return pd.DataFrame([(shard, packed(_merge_words(list(group["data"]), shard, shared.value, store)))], columns=["shard", "data"])

    parts = texts.mapInArrow(count, _PART)
    for level in range(order, 1, -1):  # a table each, so that the shuffle files of the order above go
        above, parts = parts, materialise(parts.groupBy("shard").applyInPandas(merging(level), _PART))
        if level < order:
            discard(above)
    made = parts.groupBy("shard").applyInPandas(words, _PART).collect()  # one small row per shard
    discard(parts)
    tallies = [unpacked(r["data"], 1)[0] for r in made if r["shard"] >= 0]
    word_tally = np.sum(tallies, axis=0) if tallies else np.zeros(7, np.int64)
    found = {-r["shard"]: unpacked(r["data"], 6) for r in made if r["shard"] < 0}
    none = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, np.zeros(6, np.int64)]
    by_level = {level: found.get(level, none) for level in range(2, order + 1)}
    stats = {level: x[:5] for level, x in by_level.items()}
    return Model(folder, bits, hot, order, stats, {level: discounts(x[5]) for level, x in by_level.items()}, discounts(word_tally), word_tally, int(word_tally[4]), int(word_tally[6]))


def _added(parts: list[bytes]) -> bytes:
    """Tallies, and what hot contexts add up to, of several shards: HOT_SHARE rows at most."""
    *stats, tally = ([*x] for x in zip(*(unpacked(p, 6) for p in parts), strict=True))
    context, *sums = (np.concatenate(x) for x in stats)
    return packed(*_grouped(context, sums), np.sum(tally, axis=0))


def _coded_words(texts: DataFrame, order: int) -> np.ndarray:
    """Hashes of begin, end and the most frequent words of a sample, at most as many as there are codes. They only decide how n-grams travel, never a count."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(CODE_SAMPLE)) == 0)

    def count(batches):
        hashes = WordHashes()
        for batch in batches:
            word, n = np.unique(hashes.of(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    most = (1 << min(CODE_BITS, 64 // order)) - 2
    rows = sample.mapInArrow(count, "word long, n long").where(F.col("word") != int(END.view(np.int64))).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return np.concatenate([[BEGIN, END], rows["word"].to_numpy().view(np.uint64)])


def _hot_contexts(texts: DataFrame, order: int) -> np.ndarray:
    """At most HOT_SHARE hashes of very frequent contexts of any length. They only decide where pairs are kept, never a score."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        hashes = WordHashes()
        for batch in batches:
            tokens, counts = hashes.of(batch.column(0).to_pylist())
            word, n = np.unique(np.concatenate(contexts(tokens, counts, order)), return_counts=True)
            often = n * HOT_SHARE >= len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])

    rows = sample.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HOT_SHARE).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


class Scorer:
    def __init__(self, model: Model):
        self.m, self.store, self.open = model, Store(model.folder), {}

    def table(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            if len(self.open) >= 384:  # each map holds a file open
                self.open.pop(next(iter(self.open)))
            try:
                self.open[name] = self.store.load_all(name)
            except FileNotFoundError:  # no text fell into this shard
                self.open[name] = None
        return self.open[name]

    def lookup(self, keys: np.ndarray, kind: str, count: int, read) -> list[np.ndarray]:
        """`count` values of each key, zero where there is none; the keys' top bits are their shard."""
        out = [np.zeros(len(keys), np.int64) for _ in range(count)]
        shards = (keys >> np.uint64(64 - self.m.bits)).astype(np.uint16 if self.m.bits <= 16 else np.uint32)
        order = np.argsort(shards, kind="stable")
        at = runs(shards[order])
        for a, b in zip(at, np.append(at[1:], len(keys)), strict=True):
            t, rows = self.table(f"{kind}-{int(shards[order[a]])}"), order[a:b]
            if t is not None and len(t["keys"]):
                hit, where = found(t, keys[rows], self.m.bits)
                for x, v in zip(out, read(t, where), strict=True):
                    x[rows[hit]] = v
        return out

    def __call__(self, tokens: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after its contexts(), and its count in training."""
        m = self.m
        kinds, uses = self.lookup(tokens, "words", 2, lambda t, at: [t["kinds"][at], t["uses"][at]])
        all_kinds = max(m.word_tally[5], 1)
        n1, n2 = m.word_tally[0], m.word_tally[1]
        d = m.word_discounts
        rest = (d[1] * n1 + d[2] * n2 + d[3] * (m.words - n1 - n2)) / all_kinds if m.words else 1.0
        value = (kinds - d[np.minimum(kinds, 3)]) / all_kinds + rest / (m.words + 1)
        for level, context in enumerate(reversed(before), 2):
            value = self.interpolated(tokens, context, level, value)
        return np.log10(value), uses

    def interpolated(self, tokens: np.ndarray, context: np.ndarray, level: int, low: np.ndarray) -> np.ndarray:
        """Probabilities of one order, from those of the order below."""
        m = self.m
        stats = self.lookup(context, f"contexts-{level}", 4, unbrief)
        hot_stats = m.hot_stats[level]
        if len(hot_stats[0]):
            at = np.minimum(np.searchsorted(hot_stats[0], context), len(hot_stats[0]) - 1)
            hit = np.flatnonzero(hot_stats[0][at] == context)
            for x, hot in zip(stats, hot_stats[1:], strict=True):
                x[hit] += hot[at[hit]]
        total, *n = stats
        d = m.pair_discounts[level]
        pair = mixed(context, tokens)
        key = pair_keys(shards_of(context, pair, m.bits, m.hot), pair, m.bits)
        (count,) = self.lookup(key, f"pairs-{level}", 1, unsmall)
        seen = np.maximum(total, 1)
        high = (count - d[np.minimum(count, 3)]) / seen + (d[1] * n[0] + d[2] * n[1] + d[3] * n[2]) / seen * low
        return np.where(total > 0, high, low)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `n_tokens`, `n_known`, `base_score`, `score` of each whole text.

    score is the sum of the tokens' log10 probabilities under the model, base_score
    the same under add-one counts of single tokens; perplexity is
    10 ** (-score / n_tokens). A null or empty text is its end token alone. Columns
    named like a new one are replaced, repeated rows stay.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hashes, scorer = WordHashes(), Scorer(shared.value)
        whole = np.log10(model_size(shared.value))

        def step(texts):
            tokens, counts = hashes.of(texts)
            value, uses = scorer(tokens, contexts(tokens, counts, shared.value.order))
            at = np.append(0, np.cumsum(counts)[:-1])
            return [pa.array(counts), pa.array(np.add.reduceat((uses > 0).astype(np.int64), at)), pa.array(np.add.reduceat(np.log10(uses + 1.0) - whole, at)), pa.array(np.add.reduceat(value, at))]

        return step

    return append(docs, make, fields, text)


def model_size(model: Model) -> int:
    return model.tokens + 1 * (model.words + 1)
