"""License scan: exact phrases, and fuzzy short notices found by exact seeds.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece intact
(pigeonhole). Pieces are searched exactly; around each find, bounded-error matching
decides, and gives edits and span.
"""
from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from soundgrid.llm.decontam import WORD
from soundgrid.llm.texts import WORD_BYTES, append

# The exact phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of public licence notices, in lower case without punctuation, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
}
#: A notice may differ in one character of so many.
CHARS_PER_EDIT = 10

_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType()), T.StructField("notice", T.StringType())])
_OUT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("score", T.DoubleType()),
]


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about equal length that cover the notice, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def occurrences(text: str, part: str):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def letters(notice: str) -> dict[str, int]:
    """Each character's places in the notice, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(notice):
        found[c] = found.get(c, 0) | 1 << i
    return found


def within(places: dict[str, int], length: int, window: str, edits: int) -> bool:
    """Whether some stretch of the window is at most so many edits from the notice of these letters(): Myers' columns of differences in whole numbers."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    for c in window:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score <= edits:
                return True
        more, straight = more << 1, same | down
        up, down = full & (less << 1 | ~(straight | more)), full & more & straight
    return score <= edits


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // chars_per_edit
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")
            self.notices.append((notice, label, edits, pattern, letters(notice)))
            for offset, part in pieces(notice, edits):
                seeds.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, owners in seeds.items():
            self.automaton.add_word(part, (len(part), owners))
        self.automaton.make_automaton()

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice number, start, end, edits) in the joined words: each seed's own window is verified, by distance and then for the span; of overlapping matches of a notice that with the fewest edits stays."""
        matches: dict[int, dict[tuple[int, int], int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (length, owners) in self.automaton.iter(joined):
            for number, offset in owners:
                notice, _, edits, pattern, places = self.notices[number]
                at = last + 1 - length - offset
                mine = matches.setdefault(number, {})
                if (number, at) in tried or mine.get((at, at + len(notice))) == 0:
                    continue
                tried.add((number, at))
                low, high = max(at - edits, 0), at + len(notice) + edits
                if within(places, len(notice), joined[low:high], edits) and (m := pattern.search(joined, low, high)):
                    mine[m.span()] = sum(m.fuzzy_counts)
        found = []
        for number, mine in matches.items():
            kept: list[tuple[int, int]] = []
            for (start, end), edits in sorted(mine.items(), key=lambda x: (x[1], x[0])):
                near = bisect.bisect(kept, (start, end))
                if (not near or kept[near - 1][1] <= start) and (near == len(kept) or end <= kept[near][0]):
                    kept.insert(near, (start, end))
                    found.append((number, start, end, edits))
        return sorted(found)

    def __call__(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        starts, base = [], set()
        for phrase, label in self.phrases:
            word = last = 0
            for at in occurrences(joined, phrase):
                word, last = word + joined.count(" ", last, at), at
                starts.append(word)
                base.add(label)
        fuzzy = self.fuzzy(joined)
        labels, score, out = set(base), 1.0 if base else 0.0, []
        if fuzzy:
            at, gaps = [m.span() for m in WORD.finditer(text)], [i for i, c in enumerate(joined) if c == " "]
        for number, start, end, edits in fuzzy:
            notice, label, *_ = self.notices[number]
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
            first = bisect.bisect_left(gaps, start + 1) - (joined[start] != " ")
            last = bisect.bisect_left(gaps, max(end - 1, start + 1)) - 1
            first, last = min(max(first, 0), len(at) - 1), min(max(last, 0), len(at) - 1)
            out.append({"label": label, "start": at[first][0], "end": at[max(first, last)][1], "edits": edits, "notice": notice})
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), out, score


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT, text: str = "text") -> DataFrame:
    """docs with the licences that its texts name.

    `n_base`, `first_word`, `last_word`, `base_labels`: places where the words of a
    phrase stand one after another. `spans`: notices within length / chars_per_edit
    edits, as characters [start, end) of the original text widened to whole words,
    with the edits. `labels` unites both. `score` is 1 with a phrase, else the
    closest notice's share of unedited characters, else 0. A null text counts as
    empty: no word, no label, score 0. Columns of docs named like a new one are
    replaced, all others and repeated rows stay. No shuffle.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def make():
        one = Scanner(phrases, notices, chars_per_edit)
        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)]

    return append(docs, make, _OUT, text)
