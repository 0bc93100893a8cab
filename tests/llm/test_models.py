"""Toxicity on planted words, the pipeline, and the guard of the entry module."""
import importlib
import random
import sys

import pytest
from pyspark.sql import functions as F

from soundgrid.llm import toxicity
from soundgrid.llm.queries import remainder

from odd_rows import ODD  # noqa: I001


def planted(n=900, seed=1):
    r = random.Random(seed)
    words = [f"w{''.join(r.choice('abcdefgh') for _ in range(4))}" for _ in range(400)]
    bad = ["grumpf", "snark", "blarghat", "blarghon", "blarghel"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        body = r.choices(words, k=r.randrange(5, 60))
        if toxic:
            for b in r.sample(bad, 2):
                body.insert(r.randrange(len(body)), r.choice(["you ", ""]) + b)
        rows.append((i, " ".join(body)))
        labels.append((i, None, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, docs):
    rows, labels = planted()
    labels += [(5, 1, 0), (None, 1, 1), (7, 1, None), (8, 0, 3)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, table, toxicity.fit(docs(rows), table, learn=lambda i: remainder(i, 4) != 2)


def test_toxicity_ranks_held_out_documents(docs, fitted):
    rows, labels, model = fitted
    scored = toxicity.score(docs(rows, extra=True), model).join(labels.where("toxic in (0, 1)"), "doc_id").where(remainder(F.col("doc_id"), 4) == 2)
    got = [(x["toxic"], x["score"], x["predicted"]) for x in scored.select("toxic", "score", "predicted").collect()]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in got)
    hits = [p for t, _, p in got if t]
    clean = [p for t, _, p in got if not t]
    assert sum(hits) / len(hits) > 0.9 and sum(clean) / len(clean) < 0.05


def test_toxicity_model_has_its_full_size(fitted):
    trees = fitted[2].trees
    assert trees.getNumTrees == 30 and trees.getMaxDepth() == 4


def test_toxicity_learns_from_unlike_texts_with_a_common_pair(spark, docs):
    pair = min((f"a{i} b{i}" for i in range(4000)), key=toxicity.sketch)
    rows = [(i, f"{pair} own{i} words{i}") for i in range(30)] + [(100 + i, f"{pair} own0 words0") for i in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:30]] + [(i, 0) for i, _ in rows[30:]], "doc_id long, toxic int")
    made = toxicity._sample(docs(rows), labels, lambda i: F.lit(True), 1000, "doc_id", "text").collect()
    assert sorted(r["text"] for r in made) == sorted(t for _, t in rows[:30])
    assert len({r["part"] for r in made if toxicity.sketch(r["text"]) == toxicity.sketch(pair)}) == 1


def test_toxicity_takes_odd_rows(spark, docs, fitted):
    *_, model = fitted
    out = toxicity.score(docs(ODD, extra=True), model)
    assert out.count() == len(ODD) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert out.columns[:2] == ["doc_id", "text"]
    none = toxicity.fit(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs(ODD), none).where("predicted = 0 AND score = 0").count() == len(ODD)


def test_features_see_masks_and_neighbours():
    one = toxicity.Featurizer({"snark": 5.0, "grum~": 2.0})
    f = dict(zip(toxicity.FEATURES, one("You are a snark! grumpf SHOUTED s.n.a.r.k sn4rk"), strict=True))
    assert f["strong_count"] > 0 and f["mild_count"] > 0 and f["near_you"] > 0 and f["you_density"] > 0
    assert f["shouted"] > 0 and f["exclaims"] > 0 and f["obfuscated"] > 0 and f["unmasked"] > 0
    assert len(one(None)) == len(one("")) == len(toxicity.FEATURES)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet").withColumn("score", F.lit("own")).withColumn("n_lines", F.lit(1))
    extra = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(1))
    item = spark.read.parquet(f"{root}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).withColumn("doc_id", F.lit(10**9)).withColumn("text", F.lit("Intro words here.\n" + item.upper()))
    now, names = docs.union(extra).union(leak), docs.columns
    counts = [now.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, root).write.parquet(str(tmp_path / str(number)))
        now = spark.read.parquet(str(tmp_path / str(number)))
        counts.append(now.count())
        if number < 4:
            assert now.columns == names, name
        if name == "line dedup":
            assert now.where("text IS NOT NULL AND n_chars <> char_length(text)").count() == 0
        if name == "near-dedup":
            assert now.where("doc_id IS NULL").count() <= 1 and now.groupBy("doc_id").count().where("count > 1").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[3] > counts[4] > 0 and counts[5] == counts[4]
    assert now.where("doc_id = 1000000000").count() == 0


def test_entry_imports_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(importlib.reload(entry).queries())
    assert "pipeline" in whole and whole - rest == {n for n in whole if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
