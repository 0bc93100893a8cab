"""Operators over whole tables against brute force: components, line dedup, shards, order, kNN, n-gram model."""
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundgrid.llm import bpe, knn, lines, ngram, order, shards, simhash
from soundgrid.llm.graph import components
from soundgrid.llm.queries import VOCABULARY
from test_texts import SPACED, low, slow_fingerprint

from odd_rows import ODD  # noqa: I001


def sets_of(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    made = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = sets_of({n for e in edges if e[0] != e[1] for n in e}, [e for e in edges if e[0] != e[1]])
    assert made == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius,crowd", [(1, 48), (2, 48), (3, 48), (1, 2), (2, 2), (3, 2)])
def test_links_connect_what_brute_force_connects(spark, radius, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(radius * 10 + crowd)
    fps = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(25):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 8])):
            x = base
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) * (x >> 63))
    fps = sorted(fps)
    bits = lambda a, b: ((a ^ b) % 2**64).bit_count()
    close = [(a, b) for a, b in itertools.combinations(fps, 2) if bits(a, b) <= radius]
    made = [(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(x,) for x in fps], "simhash long"), radius).collect()]
    assert all(bits(a, b) <= radius for a, b in made)
    assert sets_of(fps, made) == sets_of(fps, close)


def near_rows():
    r = random.Random(4)
    rows = []
    for i in range(12):
        words = [f"w{r.randrange(999)}" for _ in range(r.choice([2, 40, 300]))]
        for k in range(r.choice([1, 3, 6])):
            if k:
                words[r.randrange(len(words))] = f"e{k}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(i + 1000, t) if i else (i, t) for i, t in ODD]


def test_near_duplicates(docs):
    rows = near_rows()
    made = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["simhash"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs(rows, extra=True)).collect())
    fp = [slow_fingerprint(t, 3) for _, t in rows]
    root = sets_of(set(fp), [(a, b) for a, b in itertools.combinations(sorted(set(fp)), 2) if (a ^ b).bit_count() <= 2])
    least = defaultdict(lambda: None)
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[root[f]] = i if least[root[f]] is None else min(i, least[root[f]])
    assert made == sorted((i is None, i or 0, f, least[root[f]]) for (i, _), f in zip(rows, fp, strict=True))
    kept = simhash.keep_one(docs(rows, extra=True), width=3, radius=2)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert kept.columns == docs(rows, extra=True).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_dedup(rows, copy, least):
    places = sorted({(i is not None, i or 0, copy[t], n, s.strip(" \t\r")) for i, t in rows if t is not None for n, s in enumerate(t.split("\n")) if len(s.strip(" \t\r")) >= least})
    stay, seen = set(), []
    for has, i, c, n, s in places:
        if not any(one_edit(s, x) for x in seen):
            stay.add((i if has else None, c, n))
        seen.append(s)
    return ["\n".join(s for n, s in enumerate(t.split("\n")) if len(s.strip(" \t\r")) < least or (i, copy[t], n) in stay) if t is not None else None for i, t in rows]


def test_line_dedup(spark, docs):
    r = random.Random(8)
    rows = []
    for i in range(40):
        body = []
        for _ in range(r.randrange(6)):
            s = "".join(r.choice("aab é😀") for _ in range(r.choice([2, 6, 7, 8, 9]))) if r.random() < 0.5 else r.choice(["aaaaaaaa", "abababab", "bbbbaaaa"])
            if r.random() < 0.5 and s:
                k = r.randrange(len(s))
                s = s[:k] + r.choice(["", "b", "xa"]) + s[k + 1 :]
            body.append(s + r.choice(["", " ", "\r"]))
        rows.append((r.choice([i, i, None]), "\n".join(body)))
    rows += ODD
    df = docs(rows, extra=True)
    copy = {x["text"]: x["c"] for x in df.select("text", F.xxhash64("text").alias("c")).distinct().collect()}
    made = lines.dedup(df, min_chars=5)
    got = Counter((x["doc_id"], x["text"], x["n_lines"]) for x in made.collect())
    want = brute_dedup(rows, copy, 5)
    assert got == Counter((i, w, len(t.split("\n")) if t is not None else 0) for (i, t), w in zip(rows, want, strict=True))
    assert made.where("n_dropped < 0").count() == 0
    assert lines.dedup(docs([])).count() == 0


def test_line_dedup_without_broadcast(docs, monkeypatch):
    rows = [(1, "the quick brown fox jumps\nother line that is long enough"), (2, "the quick brown fox jumqs\nthe quick brown fox jumps over"), (3, "he quick brown fox jumps")]
    want = [(1, 0), (2, 1), (3, 1)]
    for limit in (400_000, 0):
        monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
        assert sorted((x["doc_id"], x["n_dropped"]) for x in lines.dedup(docs(rows)).collect()) == want


def best_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards(docs, n):
    import hashlib

    r = random.Random(n)
    rows = [(1000 + i, "z" * r.randrange(400) + str(r.randrange(40))) for i in range(150)] + ODD + [(9000 + i, "hot text " * 5) for i in range(60)]
    made = shards.assign(docs(rows, extra=True), n).collect()
    assert Counter(r["doc_id"] for r in made) == Counter(i for i, _ in rows)
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    per = defaultdict(int)
    for x in made:
        per[x["shard"]] += x["size"]
    assert max(per.values()) == best_capacity([groups[g] for g in sorted(groups)], n)
    assert all(len({x["shard"] for x in made if x["text_crc32"] == c and x["size"] == s}) == 1 for c, s in {(x["text_crc32"], x["size"]) for x in made})
    for s in per:
        assert sorted(x["slot"] for x in made if x["shard"] == s) == list(range(sum(x["shard"] == s for x in made)))
    by = {i: t for i, t in rows}
    for x in made:
        if x["doc_id"] in (3, 5, 7, 1004):
            assert (x["size"], x["text_crc32"]) == (len(by[x["doc_id"]].encode()) + 1, zlib.crc32(by[x["doc_id"]].encode()))
    assert shards.assign(docs([]), n).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(count):
    slots = order.feistel(np.arange(count), count, 9)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 60:
        assert (slots != order.feistel(np.arange(count), count, 10)).any()


@pytest.mark.parametrize("width", [1, 2])
def test_training_order(spark, docs, tmp_path, width):
    rows = [(1000 + i, " ".join(f"tok{i} é{j}" for j in range(i % 50))) for i in range(120)] + ODD
    docs(rows, extra=True).repartition(3).write.parquet(str(tmp_path / "docs"))
    table = bpe.encode(spark.read.parquet(str(tmp_path / "docs")), VOCABULARY) if width == 2 else spark.read.parquet(str(tmp_path / "docs"))
    ids = order.wide_ids(F.col("ids")) if width == 2 else order.byte_ids(F.col("text"))
    want = {r["doc_id"]: r["ids"] if width == 2 else list((r["text"] or "").encode()) for r in (table if width == 2 else bpe.encode(table, VOCABULARY)).collect()}
    sizes = [len(r["ids"]) if width == 2 else len((r["text"] or "").encode()) for r in (table if width == 2 else bpe.encode(table, VOCABULARY)).collect()]
    index, folder = order.materialise_order(table, ids, key=3, length=16, width=width, records=50)
    index = sorted(index.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in index] == list(range(len(index)))
    assert len(index) == sum(max(1, -(-n // 16)) for n in sizes)
    records = order.read_slots(folder, 0, len(index) + 5)
    assert (order.read_slots(folder, 37, 90) == records[37:127]).all()
    pieces = defaultdict(dict)
    for r in index:
        record = records[r["slot"]]
        assert (r["shard"], r["offset"]) == (r["slot"] // 50, r["slot"] % 50 * 16 * width)
        assert r["record_crc32"] == zlib.crc32(record.tobytes()) and (record[r["n_tokens"] :] == 256**width - 1).all()
        pieces[r["doc_id"]][r["seq_no"]] = record[: r["n_tokens"]].tolist()
    for i, _ in rows[:120]:
        assert sum((pieces[i][k] for k in sorted(pieces[i])), []) == want[i]
    empty, folder = order.materialise_order(docs([]), order.byte_ids(F.col("text")))
    assert empty.count() == 0 and len(order.read_slots(folder, 0, 5)) == 0


@pytest.mark.parametrize("block,chunk", [(512, 4096), (3, 20)])
def test_knn(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", block)
    monkeypatch.setattr(knn, "CHUNK_ROWS", chunk)
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    vectors = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(220)]
    vectors += [(i, [0.5] * 6) for i in range(300, 340)]  # ties
    odd = [(400, None), (410, [1.0, None]), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (None, [1.0] * 6), (440, []), (450, [0.25]), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    made = defaultdict(list)
    for x in sorted(knn.top_k(df, lambda i: i % 10 == 0, 5, pivots=8).collect(), key=lambda x: x["rank"]):
        made[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in [*vectors, (440, []), (450, [0.25]), (5, vectors[5][1])]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for at, (i, v) in ((at, r) for at, r in enumerate(rows) if r[0] % 10 == 0):
        best = sorted(((-dot(v, w), j) for k, (j, w) in enumerate(rows) if k != at))[:5]
        assert made.pop(i) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert not made
    assert knn.top_k(df.where("false"), lambda i: i % 10 == 0).count() == 0


def test_knn_keeps_repeated_rows_and_large_components(spark):
    rows = [(10, [1.0, 2.0]), (10, [1.0, 2.0]), (10, [-3.0, 0.5]), (7, [2.0e6, -1.5e6]), (20, [3.0e7, 1.0]), (3, [0.0, 0.0]), (4, [5.0e5, 8.0])]
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    got = defaultdict(list)
    for x in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, 4, pivots=3).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    want = defaultdict(list)
    for at, (i, v) in enumerate(whole):
        if i % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for k, (j, w) in enumerate(whole) if k != at)[:4]
            want[i] += [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def brute_model(texts):
    """Interpolated modified Kneser-Ney of word pairs, by dictionaries."""
    tokens = lambda t: SPACED.findall(low(t)) + [None]
    pairs, uses = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        uses.update(w)
        pairs.update(zip([False, *w], w, strict=False))
    kinds = Counter(b for _, b in pairs)

    def discount(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))]

    dp, dw = discount(pairs.values()), discount(kinds.values())
    total = Counter()
    kind_of = defaultdict(Counter)
    for (a, _), c in pairs.items():
        total[a] += c
        kind_of[a][min(c, 3)] += 1

    def low_order(b):
        if not kinds:
            return 1.0
        rest = sum(dw[min(c, 3)] for c in kinds.values())
        return (kinds[b] - dw[min(kinds[b], 3)] + rest / (len(kinds) + 1)) / len(pairs)

    def p(a, b):
        if not total[a]:
            return low_order(b)
        rest = sum(dp[k] * n for k, n in kind_of[a].items())
        return (pairs[a, b] - dp[min(pairs[a, b], 3)] + rest * low_order(b)) / total[a]

    def score(t):
        w = tokens(t)
        n = sum(uses.values())
        return len(w), sum(uses[x] > 0 for x in w), sum(math.log10((uses[x] + 1) / (n + len(uses) + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([False, *w], w, strict=False))

    return p, score, kinds


@pytest.mark.parametrize("hot", [1000, 5])
def test_ngram_model(docs, hot, monkeypatch):
    monkeypatch.setattr(ngram, "HOT_SHARE", hot)
    monkeypatch.setattr(ngram, "SAMPLE", 1)
    monkeypatch.setattr(ngram, "FLUSH_TOKENS", 300)
    r = random.Random(11)
    words = ["The", "a", "B", "cat", "é", "dog.", "ran", "x", "y", "z"]
    rows = [(i, " ".join(r.choices(words, range(10, 0, -1), k=r.randrange(40)))) for i in range(80)]
    test = rows[:20] + ODD + [(200, "new words the cat"), (201, "the the the\tthe\x0bA")]
    p, score, kinds = brute_model([t for _, t in rows])
    model = ngram.train(docs(rows))
    assert model.words == len(kinds)
    for x in ngram.score(docs(test, extra=True), model).collect():
        n, known, base, value = score(x["text"])
        assert (x["n_tokens"], x["n_known"]) == (n, known)
        assert x["base_score"] == pytest.approx(base, rel=1e-9) and x["score"] == pytest.approx(value, rel=1e-9)
    assert sum(p("the", b) for b in kinds) + p("the", "unseen") == pytest.approx(1)
    empty = ngram.train(docs([]))
    assert ngram.score(docs(test), empty).where("score > 0 OR isnan(score)").count() == 0
