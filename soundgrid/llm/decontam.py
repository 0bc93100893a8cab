"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Items and texts are normalised alike: A-Z in lower case, words of ASCII letters,
digits and all other characters, joined by one space. The automaton scans each text
once; hits are word positions, mapped back to characters of the original text.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.texts import WORD_BYTES, append

#: A word where it stands in a text, before lowering.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of windows in one automaton, which is what bounds its nodes: some 400 MB at most. More windows are scanned for in several passes.
BLOCK_BYTES = 8 << 20

_HIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
_OUT = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HIT), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def windows(text: str | None, width: int) -> set[str]:
    """The windows of an item, as space-framed strings of one character per byte."""
    w = words(text or "")
    return {" " + b" ".join(w[i : i + width]).decode("latin-1") + " " for i in range(max(len(w) - width + 1, bool(w)))}


def _scanner(items: list[tuple[str, str | None]], width: int):
    import ahocorasick

    owners: dict[str, list[str]] = {}
    for item, text in items:
        for w in windows(text, width):
            owners.setdefault(w, []).append(item)
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(w, (len(w), w.count(" ") - 1, ids))
    if owners:
        automaton.make_automaton()

    def scan(text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, mark of each hit word, items found."""
        w = words(text or "")
        joined = " " + b" ".join(w).decode("latin-1") + " "
        marks, found = np.zeros(len(w) + 1, np.int64), set()
        if owners and len(w):
            ends = None
            for at, (_, n, ids) in automaton.iter(joined):
                if ends is None:
                    ends = np.cumsum([len(x) + 1 for x in w])
                last = int(np.searchsorted(ends, at))  # the space behind a word stands at its end
                marks[last + 1 - n] += 1
                marks[last + 1] -= 1
                found.update(ids)
        return len(w), np.cumsum(marks)[:-1] > 0, found

    return scan


def spans(text: str | None, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character spans of the original text."""
    if not hit.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1], "first_word": int(a), "last_word": int(b - 1)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _blocks(items: DataFrame, item_id: str, text: str, width: int):
    """Items, a long one in overlapping parts, by blocks whose windows are bounded in size, one after another through the driver."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        w = words(row[1] or "")
        step = max(width, BLOCK_BYTES // (width * 16))
        for at in range(0, max(len(w) - width + 1, 1), step):
            part = b" ".join(w[at : at + step + width - 1])  # every window that starts in this step
            if block and size + width * len(part) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((row[0], part.decode("utf-8", "replace")))
            size += width * len(part)
    yield block


def scan(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `n_words`, `hits` and `item_ids`.

    A window is `width` consecutive words of an item, or all of an item with fewer,
    but not none. `hits` are the runs of document words inside any occurrence of a
    window, as character spans [start, end) of the original text and as word
    positions from 0; `item_ids` are the items with an occurring window, as sorted
    strings. Null texts, empty texts and items without a word have no hit; items
    without an id are left out; an item that is repeated counts once. Columns of
    docs named like a new one are replaced, all others and repeated rows stay.
    """
    spark = docs.sparkSession
    for number, block in enumerate(_blocks(items.where(F.col(item_id).isNotNull()), item_id, item_text, width)):
        shared = spark.sparkContext.broadcast(block)
        new = [T.StructField(f.name if number == 0 else f"__more_{f.name}", f.dataType) for f in _OUT]

        def make(shared=shared):
            one = _scanner(shared.value, width)

            def step(texts):
                rows = [(t, *one(t)) for t in texts]
                return [[n for _, n, _, _ in rows], [spans(t, hit) for t, _, hit, _ in rows], [sorted(found) for *_, found in rows]]

            return step

        docs = append(docs, make, new, text)
        if number:
            docs = _merged(docs)
    return docs


def _merged(docs: DataFrame) -> DataFrame:
    """Two passes' hits in one: spans that touch or overlap are joined, item ids united."""
    both = F.array_sort(F.concat("hits", "__more_hits"))
    start = F.expr("CAST(array() AS array<struct<start:int,end:int,first_word:bigint,last_word:bigint>>)")

    def fold(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["first_word"], x["first_word"]).alias("first_word"), F.greatest(last["last_word"], x["last_word"]).alias("last_word"))
        touches = (F.size(done) > 0) & (last["last_word"] + 1 >= x["first_word"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    folded = F.aggregate(both, start, fold)
    ids = F.array_sort(F.array_union("item_ids", "__more_item_ids"))
    return docs.withColumns({"hits": folded, "item_ids": ids}).drop("__more_n_words", "__more_hits", "__more_item_ids")


def n_hit(hits) -> F.Column:
    """Number of hit words."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["last_word"] - x["first_word"] + 1)


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a hit, with their own columns."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    marked = scan(docs.withColumnsRenamed(own), items, width, text=own["text"])
    return marked.where(F.size("hits") == 0).select(*[F.col(new).alias(old) for old, new in own.items()])
