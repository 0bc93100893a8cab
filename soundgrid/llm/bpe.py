"""Byte-pair encoding and decoding by a pair occurrence index.

A partition's distinct pieces lie one after another in flat arrays. An index maps
the rank of each adjacent pair to all positions where it stands; active ranks are
applied in ascending order to all their positions at once, and only the lists of
the neighbours that a merge touches are updated.
"""
from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.texts import append, quoted, without

# The split pattern of the byte-level vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers between batches.
REMEMBERED = 300_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Ids, ranks and token bytes of a byte-level BPE file; small enough to send to every task.

    Raises ValueError for files that ask for more than byte-level BPE: normalizers,
    prefix spaces, dropout, or added tokens that strip or need word borders.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    added = spec.get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError(f"{path}: an added token that strips or needs word borders")
    ids, names = model["vocab"], byte_names()
    size = max([*ids.values(), *(t["id"] for t in added)]) + 1
    token_bytes = [b""] * size
    for token, i in ids.items():
        token_bytes[i] = b"".join(bytes([names[c]]) if c in names else c.encode() for c in token)
    for t in added:
        token_bytes[t["id"]] = t["content"].encode()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    triples = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
    return {"size": size, "bytes": token_bytes, "merges": triples, "first": np.array([ids[c] for c, _ in sorted(names.items(), key=lambda x: x[1])], np.int32), "added": {t["content"]: t["id"] for t in added}}


class PairIndex:
    """Applies the merges of a vocabulary to many pieces at once."""

    def __init__(self, vocabulary: dict):
        merges, self.size = vocabulary["merges"], vocabulary["size"]
        keys = merges[:, 0] * self.size + merges[:, 1]
        order = np.argsort(keys, kind="stable")
        keys, self.rank_of = keys[order], order.astype(np.int32)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.left, self.right, self.made = (merges[:, i].astype(np.int32) for i in range(3))
        self.first = vocabulary["first"]
        made_at = np.full(self.size, -1, np.int64)
        made_at[self.made] = np.arange(len(merges))
        if (np.maximum(made_at[self.left], made_at[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token that only a later merge makes")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        found = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.rank_of[np.minimum(at, len(self.rank_of) - 1)], -1) if len(self.rank_of) else np.full(len(key), -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each."""
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbol = self.first[flat]
        symbol[ends] = -1  # borders pair with nothing
        n = len(symbol)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(rank: np.ndarray, position: np.ndarray) -> None:
            known = rank >= 0
            rank, position = rank[known], position[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, where in zip(rank[np.append(0, cut)].tolist(), np.split(position, cut), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(where)

        enter(self.ranks(symbol[:-1], symbol[1:]), np.arange(n - 1, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            where = index.pop(r)
            at = np.unique(np.concatenate(where)) if len(where) > 1 else where[0]
            a, b = self.left[r], self.right[r]
            at = at[symbol[at] == a]
            at = at[symbol[following[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair remains
                starts = np.append(True, following[at[:-1]] != at[1:])
                within = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[within % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            symbol[at], symbol[gone] = self.made[r], -2
            following[at], before[after] = after, at
            prior = before[at]
            prior = prior[prior >= 0]
            touched = np.concatenate((prior, at))
            enter(self.ranks(symbol[touched], symbol[following[touched]]), touched)
        alive = symbol >= 0
        counts = np.add.reduceat(alive, np.append(0, ends[:-1] + 1)) if len(pieces) else np.zeros(0, np.int64)
        return symbol[alive], counts.astype(np.int64)


def gather(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs [start, start + length) one after another, and their offsets."""
    offsets = np.append(0, np.cumsum(lengths))
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths), offsets


class Encoder:
    """Texts to ids; remembers the units of the texts before, up to a bound.

    A single space between two other characters always starts a piece, so texts
    are cut there into units, and only units not met before are split by the
    pattern. Texts with other white space around a space are split as a whole.
    """

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        import re

        import regex

        self.index, self.added, self.remembered = PairIndex(vocabulary), vocabulary["added"], remembered
        self.split = regex.compile(PATTERN).findall
        self.simple = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?]?)\Z").match
        white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        self.uneven = ["\0", *(" " + c for c in white), *(c + " " for c in white)]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.number = {t: i for i, t in enumerate(self.added)}
        self.ids = np.array(list(self.added.values()), np.int32)
        self.starts, self.lengths = np.arange(len(self.added)), np.ones(len(self.added), np.int64)

    def plain_units(self, text: str) -> list[str]:
        if not text or text[0] == " " or text[-1] == " " or any(x in text for x in self.uneven):
            return self.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def units(self, text: str) -> list[str]:
        if self.special is None or not any(t in text for t in self.added):
            return self.plain_units(text)
        out, last = [], 0
        for m in self.special.finditer(text):
            out += self.plain_units(text[last : m.start()])
            out.append(m[0])
            last = m.end()
        return out + self.plain_units(text[last:])

    def learn(self, new: list[str]) -> None:
        pieces = [[x for x in m.groups() if x] if (m := self.simple(u)) else self.split(u) for u in new]
        ids, counts = self.index.encode([p.encode() for x in pieces for p in x])
        counts = np.add.reduceat(counts, np.append(0, np.cumsum([len(x) for x in pieces[:-1]], dtype=np.int64)))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.append(0, np.cumsum(counts[:-1])))
        self.lengths, self.ids = np.append(self.lengths, counts), np.append(self.ids, ids)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's offset (one more than texts)."""
        if len(self.number) > self.remembered:
            self.forget()
        parts = [self.units(t) if t else [] for t in texts]
        words = [w for p in parts for w in p]
        if new := list(set(words).difference(self.number)):
            self.learn(new)
        each = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        at, ends = gather(self.starts[each], self.lengths[each])
        return self.ids[at], ends[np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))]


class Decoder:
    """Ids to texts; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, vocabulary: dict):
        table = vocabulary["bytes"]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths[:-1]))

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        at, ends = gather(self.starts[ids], self.lengths[ids])
        data, ends = self.flat[at].tobytes(), ends[offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _int_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_DECODED = T.StructField("decoded", T.StringType())


def encode(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """df with `ids` array<int> of every whole text; a null or empty text has none.

    Needs no shuffle. Strings of added tokens in a text become their id. A column
    `ids` of df is replaced; all others, and repeated rows, stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def make():
        encoder = Encoder(shared.value)
        return lambda texts: [_int_lists(*encoder(texts))]

    return append(df, make, [_IDS], text)


def encode_wide(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """As encode(), with `ids` as a binary of two little-endian bytes for each id; ids from 65535 on are refused."""
    vocabulary = load_vocabulary(vocabulary_path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    if max([len(vocabulary["bytes"]) - 1, *vocabulary["added"].values()]) >= 2**16 - 1:
        raise ValueError("the vocabulary has ids that do not fit two bytes beside the padding")

    def make():
        encoder = Encoder(shared.value)

        def step(texts):
            ids, offsets = encoder(texts)
            data = ids.astype("<u2").tobytes()
            return [pa.array([data[2 * a : 2 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())]

        return step

    return append(df, make, [T.StructField("ids", T.BinaryType())], text)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the text of its array of ids; null ids give an empty text, ids outside the vocabulary nothing."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = without(df, ["decoded"])
    schema = T.StructType([*[df.schema[c] for c in kept], _DECODED])
    at = kept.index(ids)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            rows = [[i for i in x or () if i is not None and 0 <= i < len(decoder.lengths)] for x in batch.column(at).to_pylist()]
            texts = decoder(np.array([i for x in rows for i in x], np.int64), np.append(0, np.cumsum([len(x) for x in rows], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return df.select(*[F.col(quoted(c)) for c in kept]).mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass: df with `ids` and with `decoded`, made from the ids alone."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def step(texts):
            ids, offsets = encoder(texts)
            return [_int_lists(ids, offsets), pa.array(decoder(ids, offsets), pa.string())]

        return step

    return append(df, make, [_IDS, _DECODED], text)
