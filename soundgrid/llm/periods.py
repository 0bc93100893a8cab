"""Maximal periodic runs of words, by a dictionary of basic factors.

The dictionary names every stretch of 1, 2, 4, ... words that occurs more than once
in its text. Where the next occurrence of such a stretch is at most twice its length
away, the occurrences form an arithmetic progression, and its step is proposed as a
period. A proposal is extended both ways by the dictionary's own names, longest
stretches first; equal results count once.
"""
from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.texts import append

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys (equal ones by place), the starts of equal ones in it, and how many are equal."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(keys)))


class Factors:
    """The dictionary of one or more texts laid end to end; a stretch never equals one of another text, and none crosses an end."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.n = len(words)
        self.levels: list[np.ndarray] = []
        self.proposed: list[tuple[np.ndarray, np.ndarray]] = []
        text = np.repeat(np.arange(len(lengths)), lengths)
        keys, here, size = text * (int(words.max(initial=0)) + 1) + words, np.arange(self.n), 1
        while len(here):
            order, at, times = _names(keys)
            names = np.full(self.n, -1, np.int32)
            names[here[order]] = np.where(np.repeat(times, times) > 1, np.repeat(np.arange(len(at)), times), -1)
            if not (times > 1).any():
                break
            self.levels.append(names)
            self._propose(here[order], np.repeat(np.arange(len(at)), times), size)
            here = np.flatnonzero(names >= 0)
            here = here[here + size < self.n]
            here = here[names[here + size] >= 0]
            keys = names[here].astype(np.int64) * self.n + names[here + size]
            size *= 2

    def _propose(self, places: np.ndarray, names: np.ndarray, size: int) -> None:
        """Steps to the next occurrence within 2 * size, once per stretch of places that have the same one."""
        step = places[1:] - places[:-1]
        near = np.flatnonzero((names[1:] == names[:-1]) & (step <= 2 * size))
        place, step = places[near], step[near]
        order = np.lexsort((place, step))
        place, step = place[order], step[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (step[1:] != step[:-1])
        self.proposed.append((place[new], step[new]))

    def _same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names, inside = self.levels[level], (a >= 0) & (b < self.n)
        x, y = names[np.where(inside, a, 0)], names[np.where(inside, b, 0)]
        return inside & (x == y) & (x >= 0)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs with LEAST_WORDS and LEAST_PERIODS, by start and period.

        Equal stretches a step apart are shorter than twice the longest named ones,
        so taking each length once is exact. A step that is no smallest period is
        never the distance to the next occurrence in a run of three periods.
        """
        if not self.levels:
            return (np.zeros(0, np.int64),) * 3
        start, period = (np.concatenate(x) for x in zip(*self.proposed, strict=True))
        end = start.copy()
        for level in reversed(range(len(self.levels))):
            size = 1 << level
            end += size * self._same(level, end, end + period)
            start -= size * self._same(level, start - size, start - size + period)
        length = end - start + period
        keep = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
        found = np.unique(np.stack([start[keep], period[keep], length[keep]], 1), axis=0)
        return found[:, 0], found[:, 2], found[:, 1]


def split(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, numbers of all words in a row (equal words, equal numbers), and the words of each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space alone
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    number = defaultdict(count().__next__)
    return words, np.fromiter((number[x] for w in words for x in w), np.int64, lengths.sum()), lengths


def kept(length: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if each run is cut to its first period."""
    change = np.zeros(length + 1, np.int64)
    for start, size, period in found:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `n_words`, `runs` (start, length, period by word numbers from 0), `strongest` (the run of greatest length / period) and `collapsed`.

    Words stand between ASCII white space. A run is a maximal stretch of words whose
    smallest period fits LEAST_PERIODS times, of LEAST_WORDS or more. `collapsed` is
    the text's words joined by single spaces without those that a run holds after
    its first period. Ties of `strongest` go to the smaller start, then period; it is
    null without a run. Null and empty texts have no words and an empty `collapsed`.
    Whole texts are worked on, several short ones at a time; rows that repeat stay,
    columns named like a new one are replaced.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())]

    def make():
        def step(texts):
            words, numbers, lengths = split(texts)
            ends = np.cumsum(lengths)
            start, length, period = Factors(numbers, lengths).runs()
            owner = np.searchsorted(ends, start, side="right")
            own: dict[int, list] = defaultdict(list)
            for o, s, n, p in zip(owner.tolist(), (start - (ends - lengths)[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
                own[o].append((s, n, p))
            runs = [own.get(i, []) for i in range(len(texts))]
            best = [min(r, key=lambda x: (Fraction(-x[1], x[2]), x[0], x[2])) if r else None for r in runs]
            left = [[w[i] for i in np.flatnonzero(kept(len(w), r))] if r else w for w, r in zip(words, runs, strict=True)]
            name = lambda r: dict(zip(RUN.names, r, strict=True))
            return [lengths.tolist(), [[name(x) for x in r] for r in runs], [r and name(r) for r in best], [b" ".join(w).decode("utf-8", "surrogatepass") for w in left]]

        return step

    return append(docs, make, fields, text)


def repeated(text, seed) -> F.Column:
    """A text whose words from some place on repeat with some period, both drawn from a number: see op11."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.greatest(F.size(words), F.lit(1))
    from_ = F.pmod(seed, n).cast("int")
    period = (F.lit(1) + F.floor((n - from_) / (F.lit(3) + F.pmod(seed, F.lit(8))))).cast("int")
    block = F.slice(words, from_ + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - from_) / period).cast("int"))), F.lit(1), n - from_)
    return F.array_join(F.concat(F.slice(words, F.lit(1), from_), tail), " ")
