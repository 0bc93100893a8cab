"""Per-text operators against plain Python: BPE, decontamination, licences, fingerprints, toxicity features."""
import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from soundgrid.llm import bpe, decontam, licenses, simhash
from soundgrid.llm.queries import VOCABULARY

from odd_rows import ODD  # noqa: I001

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def mixed_texts(n=150, seed=3):
    r = random.Random(seed)
    alphabet = "abcdeABC  \n\t.,'!?019éñß中😀  \x1c"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]
    return texts + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaa aaaa aa", "don't we'LL  they're", " lead", "trail ", "a \n b", "x\x00y z"]


def test_bpe_is_the_librarys(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(mixed_texts())) + ODD
    made = bpe.round_trip(docs(rows, extra=True), VOCABULARY).collect()
    assert len(made) == len(rows)
    for r in made:
        want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs(rows), VOCABULARY), VOCABULARY)
    assert again.where("decoded <> coalesce(text, '')").count() == 0


def test_bpe_splits_every_character_like_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    encoder = bpe.Encoder(bpe.load_vocabulary(VOCABULARY))
    r = random.Random(1)
    chars = [chr(c) for c in range(0x3100) if chr(c).strip() == "" or not chr(c).isalpha()] + [chr(r.randrange(0xE000, 0x110000)) for _ in range(500)]
    texts = ["\n".join(f"a{c}b {c} 1{c}{c}" for c in chars[i : i + 100]) for i in range(0, len(chars), 100)]
    ids, offsets = encoder(texts)
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_without_harm():
    encoder, small = bpe.Encoder(bpe.load_vocabulary(VOCABULARY)), bpe.Encoder(bpe.load_vocabulary(VOCABULARY), remembered=5)
    texts = mixed_texts(60)
    whole = encoder(texts)[0].tolist()
    assert whole == [i for t in texts for i in small([t])[0].tolist()]


def brute_hits(text, items, width=10):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall(low(body))
        n = min(width, len(w))
        if not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    r = random.Random(5)
    vocabulary = ["Aa", "b", "cé", "d1", "E"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 12, 15, 1, 10))] + [(7, ""), (8, None), (None, "b b"), (9, "...")]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(r.randrange(80)))) for i in range(60)] + [(100, "x " + items[2][1].upper() + " y"), *ODD]
    made = decontam.scan(docs(rows, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    for row in made.withColumn("hit", decontam.n_hit(F.col("hits"))).collect():
        assert (row["n_words"], row["hit"], row["item_ids"]) == brute_hits(row["text"], [i for i in items if i[0] is not None])
        covered = sum(len(WORD.findall(low(row["text"][h["start"] : h["end"]]))) for h in row["hits"])
        assert covered == row["hit"]
    clean = decontam.clean(docs(rows, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs(rows, extra=True).columns
    assert clean.count() == sum(brute_hits(t, [i for i in items if i[0] is not None])[1] == 0 for _, t in rows)
    assert decontam.scan(docs(rows[:5]), spark.createDataFrame([], "item_id long, text string")).where("size(hits) > 0").count() == 0


def test_licenses(docs):
    r = random.Random(9)
    bits = ["GNU General Public License", "apache license", "CC BY", "MIT-License", "cc", "by", "license", "x", "Released under the MIT License", "Relaesed under teh MIT License", "Licensed under CC BY-NC 4.0", "permision is hereby granted, free of charge, to any person obtaning a copy"]
    rows = [(i, r.choice([" ", "\n", ". "]).join(r.choice(bits) for _ in range(r.randrange(7)))) for i in range(80)] + ODD
    for row in licenses.scan(docs(rows, extra=True)).collect():
        words = WORD.findall(low(row["text"]))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == (min(places, default=None), max(places, default=None))
        assert row["base_labels"] == sorted(labels) and set(row["labels"]) >= labels
        assert row["score"] == 1.0 if places else 0 <= row["score"] <= 1
        for s in row["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(row["text"])


def test_license_notice_with_edits_and_its_span(docs):
    text = "Intro. Permision is hereby granted, free of charge, to any person obtaning a copy! End."
    row = licenses.scan(docs([(1, text)])).first()
    assert row["labels"] == ["mit"] and row["n_base"] == 0 and 0.9 < row["score"] < 1
    span = row["spans"][0]
    assert text[span["start"] : span["end"]] == "Permision is hereby granted, free of charge, to any person obtaning a copy"
    assert span["edits"] == 2


def slow_fingerprint(text, width):
    from xxhash import xxh64_intdigest

    w = SPACED.findall(low(text))
    shingles = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    rows = list(enumerate(mixed_texts(80))) + ODD
    for width in (3, 5):
        for row in simhash.fingerprints(docs(rows, extra=True), width).collect():
            assert row["simhash"] % 2**64 == slow_fingerprint(row["text"], width)


def test_digests_of_the_queries(spark):
    from soundgrid.llm.queries import op3_bpe

    root = "/root/testdata/sf0.001"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").limit(20).collect()}
    for row in op3_bpe(spark, root).where(F.col("doc_id").isin(list(texts))).collect():
        ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()
