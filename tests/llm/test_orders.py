"""Kneser-Ney models of higher orders against dictionaries."""
import math
import random
from collections import Counter, defaultdict

import pytest

from soundgrid.llm import ngram
from test_texts import SPACED, low

from odd_rows import ODD  # noqa: I001


def brute_score(texts, order):
    """Score of a text by the recursion, with n-grams as tuples; False stands before a text, None ends it."""
    grams = lambda t: [tuple(w[i : i + order]) for w in [[False] * (order - 1) + SPACED.findall(low(t)) + [None]] for i in range(len(w) - order + 1)]
    counts = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, total, after = {}, {}, {}
    for k, c in counts.items():
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
        d[k] = [0, *(j - (j + 1) * y * n[j] / n[j - 1] for j in (1, 2, 3))] if min(n) else [0]
        d[k] = d[k] if min(d[k][1:], default=0) > 0 else [0, 0.5, 1.0, 1.5]
        total[k], after[k] = Counter(), defaultdict(float)
        for g, x in c.items():
            total[k][g[:-1]] += x
            after[k][g[:-1]] += d[k][min(x, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if not total[k][g[:-1]]:
            return lower
        x = counts[k][g]
        return (x - d[k][min(x, 3)] + after[k][g[:-1]] * lower) / total[k][g[:-1]]

    return lambda t: sum(math.log10(p(g)) for g in grams(t))


@pytest.mark.parametrize("order,hot", [(2, 1000), (3, 1000), (3, 5), (4, 1000)])
def test_orders(docs, order, hot, monkeypatch):
    monkeypatch.setattr(ngram, "HOT_SHARE", hot)
    monkeypatch.setattr(ngram, "SAMPLE", 1)
    monkeypatch.setattr(ngram, "FLUSH_TOKENS", 300)
    r = random.Random(12)
    words = ["The", "a", "B", "cat", "é", "dog.", "ran", "x"]
    rows = [(i, " ".join(r.choices(words, range(8, 0, -1), k=r.randrange(40)))) for i in range(80)]
    score = brute_score([t for _, t in rows], order)
    model = ngram.train(docs(rows), order=order)
    for x in ngram.score(docs(rows[:20] + ODD + [(200, "new words the cat"), (201, "the the the a a")]), model).collect():
        assert x["score"] == pytest.approx(score(x["text"] or ""), rel=1e-9)
