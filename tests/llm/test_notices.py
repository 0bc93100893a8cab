"""Fuzzy notices against the edit distance at every position."""
import random

import numpy as np

from soundgrid.llm import licenses


def least_edits(text, notice):
    """For each end in the text the fewest edits of a stretch that ends there."""
    row = np.arange(len(notice) + 1)
    out = []
    for c in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, x in enumerate(notice, 1):
            new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c))
        row = new
        out.append(row[-1])
    return out


def edited(r, notice, edits):
    s = list(notice)
    for at in r.sample(range(1, len(s) - 1), edits):
        s[at] = r.choice(["", "q", s[at] + "z"])
    return "".join(s)


def test_every_notice_once_with_its_least_edits():
    r = random.Random(8)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    notices = list(licenses.NOTICES)
    for _ in range(40):
        number = r.randrange(len(notices))
        notice, bound = notices[number], len(notices[number]) // licenses.CHARS_PER_EDIT
        parts, planted = [], 0
        for _ in range(4):
            parts.append("".join(r.choice("abcde ") for _ in range(r.randrange(10, 40))))
            if r.random() < 0.7:
                parts.append(edited(r, notice, r.randrange(bound + 1)))
                planted += 1
        text = " " + " ".join(parts) + " "
        mine = [x for x in scanner.fuzzy(text) if x[0] == number]
        ends = least_edits(text, notice)
        assert len(mine) >= planted and all(b[1] >= a[2] for a, b in zip(mine, mine[1:], strict=False))
        for _, start, end, edits in mine:
            assert edits <= bound and least_edits(text[start:end], notice)[-1] <= edits
        for at, fewest in enumerate(ends):  # a stretch within the bound overlaps a reported one
            if fewest <= bound:
                assert any(s < at + 1 + bound and at + 1 - len(notice) - bound < e for _, s, e, _ in mine)


def test_notices_side_by_side():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    text = "releasxd under the mxt license released under the mit license releasxd undr the mit license"
    spans = [(s["start"], s["end"], s["edits"]) for s in scanner(text)[6] if s["notice"] == "released under the mit license"]
    assert [e for *_, e in spans] == [2, 0, 2] and [text[a:b] for a, b, _ in spans] == ["releasxd under the mxt license", "released under the mit license", "releasxd undr the mit license"]


class Counted:
    def __init__(self, pattern):
        self.pattern, self.searches = pattern, 0

    def search(self, *args):
        self.searches += 1
        return self.pattern.search(*args)


def test_seeds_without_a_notice_are_left_by_their_distance():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    scanner.notices = [(notice, label, edits, Counted(pattern), *rest) for notice, label, edits, pattern, *rest in scanner.notices]
    seeds = [part for notice in licenses.NOTICES for _, part in licenses.pieces(notice, len(notice) // licenses.CHARS_PER_EDIT)]
    assert not scanner("\n".join(f"some {s.strip()} more of other words" for s in seeds * 3))[6]
    assert sum(n[3].searches for n in scanner.notices) == 0
    assert scanner("released under the mit license")[6] and sum(n[3].searches for n in scanner.notices) > 0


def test_the_distance_of_a_window():
    r = random.Random(9)
    for _ in range(300):
        notice = "".join(r.choice("ab ") for _ in range(r.randrange(1, 70)))
        window = edited(r, notice, min(r.randrange(9), max(len(notice) - 2, 0))) + "".join(r.choice("ab ") for _ in range(r.randrange(9)))
        least = min([len(notice), *least_edits(window, notice)])
        assert [licenses.within(licenses.letters(notice), len(notice), window, k) for k in range(len(notice))] == [least <= k for k in range(len(notice))]
