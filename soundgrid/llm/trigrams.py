"""Boolean trigram queries of regular expressions: what any match must hold, as alternatives of trigrams, after Cox's analysis for code search.

An expression is read bottom up. Small sets of strings are kept whole; where they
grow too large, only their trigrams and their outer two characters are kept, which
give trigrams across the seams.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

#: Strings of an exact set, alternatives of a query, trigrams of an alternative, characters of a class at most. Beyond, a query only asks for less.
STRINGS, ALTERNATIVES, GRAMS, CHARACTERS = 64, 64, 48, 10

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative asks for nothing
ANYTHING: Query = frozenset([frozenset()])


def grams(strings) -> Query:
    return simple(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def simple(alternatives) -> Query:
    """Without alternatives that ask for more than another one."""
    every = {frozenset(sorted(a)[:GRAMS]) for a in alternatives}
    least = frozenset(a for a in every if not any(b < a for b in every))
    return least if len(least) <= ALTERNATIVES else ANYTHING


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:
        return min((q for q in (a, b) if q != ANYTHING), key=len, default=ANYTHING)
    return simple(x | y for x, y in product(a, b))


@dataclass(frozen=True)
class Part:
    """What is known of the strings that a part of an expression matches: all of them, or the query and their first and last two characters."""

    exact: frozenset | None = None
    first: frozenset = frozenset([""])
    last: frozenset = frozenset([""])
    query: Query = ANYTHING

    @property
    def asks(self) -> Query:
        return grams(self.exact) if self.exact is not None else self.query

    def starts(self) -> frozenset:
        return frozenset(s[:2] for s in self.exact) if self.exact is not None else self.first

    def ends(self) -> frozenset:
        return frozenset(s[-2:] for s in self.exact) if self.exact is not None else self.last


NOTHING, SOMETHING = Part(frozenset([""])), Part()


def _joined(a: frozenset, b: frozenset) -> frozenset | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= STRINGS else None


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and (whole := _joined(a.exact, b.exact)) is not None:
        return Part(whole)
    query, seam = both(a.asks, b.asks), _joined(a.ends(), b.starts())
    if seam is not None:
        query = both(query, grams(seam))
    first = a.exact is not None and _joined(a.exact, b.starts())
    last = b.exact is not None and _joined(a.ends(), b.exact)
    return Part(None, frozenset(s[:2] for s in first) if first else a.starts(), frozenset(s[-2:] for s in last) if last else b.ends(), query)


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Part(a.exact | b.exact)
    return Part(None, a.starts() | b.starts(), a.ends() | b.ends(), simple(a.asks | b.asks))


def _chosen(items) -> Part:
    found: set[str] = set()
    for kind, value in items:
        low, high = value if kind is C.RANGE else (value, value)
        if kind not in (C.RANGE, C.LITERAL) or high - low > 255 or high > 127:
            return SOMETHING
        found |= {chr(c).lower() for c in range(low, high + 1)}
    return Part(frozenset(found)) if len(found) <= CHARACTERS else SOMETHING


def _part(kind, value) -> Part:
    if kind is C.LITERAL:
        return Part(frozenset([chr(value).lower()])) if value < 128 else SOMETHING
    if kind is C.IN:
        return _chosen(value)
    if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return NOTHING
    if kind is C.SUBPATTERN:
        return _whole(value[-1])
    if kind is C.BRANCH:
        parts = [_whole(x) for x in value[1]]
        for p in parts[1:]:
            parts[0] = _either(parts[0], p)
        return parts[0]
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        one = _whole(inner)
        if (least, most) == (0, 1):
            return _either(one, NOTHING)
        made = NOTHING
        for _ in range(min(least, 3)):
            made = _then(made, one)
        return made if least == most <= 3 else Part(None, made.starts(), one.ends() if least else made.ends(), made.asks) if least else SOMETHING
    return SOMETHING


def _whole(items) -> Part:
    made = NOTHING
    for kind, value in items:
        made = _then(made, _part(kind, value))
    return made


def query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams: any text with a match holds, its ASCII letters lowered, all trigrams of one. An empty list: nothing is mandatory."""
    found = _whole(parser.parse(pattern)).asks
    return [] if frozenset() in found else sorted(map(sorted, found))
