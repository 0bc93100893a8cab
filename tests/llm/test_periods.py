"""Periodic runs against a scan of every period."""
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from soundgrid.llm import periods, queries

from odd_rows import ODD  # noqa: I001


def brute(words):
    """All (start, length, period) by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # the least period of a stretch comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(words):
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return runs, best, [w for i, w in enumerate(words) if i not in drop]


def made_texts(seed=5, n=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words, alphabet = [], [f"w{i}" for i in range(r.choice([1, 2, 3, 30]))]
        for _ in range(r.randrange(5)):
            block = [r.choice(alphabet) for _ in range(r.randrange(1, 20))]
            words += block * r.randrange(1, 9) + block[: r.randrange(len(block))] + [r.choice(alphabet) for _ in range(r.randrange(6))]
        out.append(words)
    fib = ["a"], ["a", "b"]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    return [*out, fib[1], ["a"] * 500, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], ["x", "y", "z"] * 8 + ["x", "y"] * 12]


def test_all_runs_are_found(docs):
    texts = made_texts()
    rows = [(i, "\t".join(w) + " \n") for i, w in enumerate(texts)]
    for r in periods.collapse(docs(rows, extra=True)).collect():
        runs, best, left = expected(texts[r["doc_id"]])
        assert [tuple(x) for x in r["runs"]] == runs
        assert (tuple(r["strongest"]) if r["strongest"] else None) == best
        assert r["collapsed"] == " ".join(left)
        assert r["n_words"] == len(texts[r["doc_id"]])


def test_texts_of_one_slice_do_not_meet():
    words = [["a", "b", "c"] * 5, ["a", "b", "c"] * 5, ["c"] * 30]
    lengths = np.array([15, 15, 30])
    number = {"a": 0, "b": 1, "c": 2}
    start, length, period = periods.Factors(np.array([number[w] for t in words for w in t]), lengths).runs()
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(30, 30, 1)]


def test_odd_rows(docs):
    made = periods.collapse(docs(ODD, extra=True)).collect()
    assert sorted(map(str, (r["doc_id"] for r in made))) == sorted(str(r[0]) for r in ODD)
    for r in made:
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        if len(set(words)) == 1 and len(words) >= 24:
            assert [tuple(x) for x in r["runs"]] == [(0, len(words), 1)] and r["collapsed"] == words[0].decode()
        else:
            assert not r["runs"] and r["strongest"] is None and r["collapsed"].split() == [w.decode() for w in words]
    assert periods.collapse(docs([])).collect() == []


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query_is_the_brute_force_one(spark, docs, tmp_path):
    texts = [" ".join(w) for w in made_texts(seed=8, n=60)] + [" ".join(f"u{i}" for i in range(n)) for n in range(1, 90)]
    rows = list(enumerate(texts * 4)) + [r for r in ODD if r[0] not in (5, 8)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(made) == len(rows)
    want, changed = [], 0
    for doc_id, text in rows:
        words = planted(doc_id, text)
        changed += words != (text or "").encode().split()
        runs, best, left = expected(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in made), key=key) == sorted(want, key=key)
    assert changed > 20
