"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""
from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundgrid.llm.texts import WORD_BYTES, append, quoted, without
from soundgrid.session import materialise

#: Labelled rows that the model may learn from, at most; the rest is not read for learning.
MAX_LABELLED = 12_000
#: Terms that may enter the lexicon, at most.
MAX_TERMS = 400
THRESHOLD = 0.3
#: Lengths of word beginnings that count as terms beside whole words.
STEMS = (4, 5, 6, 7)
NEAR = 4
#: Log odds from which a term is strong.
STRONG = math.log(25)

# Second-person pronouns of the corpus' languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
OBFUSCATED = re.compile(r"[A-Za-z]+(?:[0-9@$!|*]+[A-Za-z]+)+|[A-Za-z](?:[.\-_*][A-Za-z]){2,}")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
STRETCHED = re.compile(r"([A-Za-z])\1{3,}")
FEATURES = ["words", "strong_density", "strong_count", "mild_density", "mild_count", "weight_density", "weight_most", "near_you", "you_density", "capitals", "shouted", "exclaims", "asks", "punctuation", "digits", "obfuscated", "unmasked", "stretched", "word_length"]


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings with a mark behind."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "replace") for w in (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()]


def sketch(text: str | None) -> int:
    """The least hash of two words in a row: mostly the same for near-equal texts."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()
    return min((xxh64_intdigest(a + b" " + b) for a, b in zip(w, w[1:] or [b""], strict=False)), default=0) >> 1


class Featurizer:
    """Values of FEATURES for a text, with the lexicon's log odds by term."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.weights = terms, {}

    def weight(self, word: str) -> float:
        """The largest log odds of the word's terms; -1 for the second person, 0 for other words."""
        most = max((self.terms.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return most or -float(word in SECOND_PERSON)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        w = text.encode("utf-8", "replace").translate(WORD_BYTES).split()
        if len(self.weights) > 400_000:
            self.weights.clear()
        known = self.weights
        for x in set(w).difference(known):
            known[x] = self.weight(x.decode("utf-8", "replace"))
        weights = np.fromiter(map(known.__getitem__, w), float, len(w))
        strong, mild, you = np.flatnonzero(weights > STRONG), np.flatnonzero((weights > 0) & (weights <= STRONG)), np.flatnonzero(weights < 0)
        near = 0
        if len(strong) and len(you):
            at = np.searchsorted(you, strong)
            left, right = strong - you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)] - strong
            near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
        masked = [m[0] for m in OBFUSCATED.finditer(text)]
        unmasked = sum(self.weight(re.sub(r"[^a-z]", "", m.lower().translate(LOOKALIKES))) > STRONG for m in masked)
        n, chars = max(len(w), 1), max(len(text), 1)
        ascii_bytes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        letters = max(int(ascii_bytes[65:91].sum() + ascii_bytes[97:123].sum()), 1)
        return [
            math.log1p(len(w)), len(strong) / n, math.log1p(len(strong)), len(mild) / n, math.log1p(len(mild)), float(np.maximum(weights, 0).sum()) / n, float(weights.max(initial=0.0)), near / n, len(you) / n,
            int(ascii_bytes[65:91].sum()) / letters, len(CAPITALS.findall(text)) / n, int(ascii_bytes[33]) / n, int(ascii_bytes[63]) / n,
            int(ascii_bytes[33:48].sum() + ascii_bytes[58:65].sum()) / chars, int(ascii_bytes[48:58].sum()) / chars, len(masked) / n, unmasked / n, len(STRETCHED.findall(text)) / n, chars / n]


@dataclass
class Model:
    terms: dict[str, float]
    base_rate: float
    trees: GBTClassificationModel | None = field(default=None)
    calibration: IsotonicRegressionModel | None = field(default=None)


def _sample(docs: DataFrame, labels: DataFrame, learn, max_rows: int, doc_id: str, text: str) -> DataFrame:
    """(part, toxic, text) of at most max_rows labelled documents, one of equal texts; part 0: lexicon, 1: trees, 2: calibration, near-equal texts mostly in the same."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(learn(F.col("doc_id"))).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = append(rows, lambda: lambda texts: [[sketch(t) for t in texts]], [T.StructField("sketch", T.LongType())])
    name = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit("text"), "text").alias("g")]
    rows = rows.groupBy("sketch", "toxic", *name).agg(F.min_by("text", "doc_id").alias("text"))
    return materialise(rows.select(F.pmod(F.col("sketch"), F.lit(10)).alias("tenth"), "toxic", "text").select(F.when(F.col("tenth") < 4, 0).when(F.col("tenth") < 8, 1).otherwise(2).alias("part"), "toxic", "text"))


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """At most MAX_TERMS terms that are far more frequent among toxic texts, with their log odds."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(4, toxic // 100)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def counter(only=None):
        def count(batches):
            from collections import Counter

            held = Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    seen = {x for w in set(words(t)) for x in terms_of(w)}
                    held.update(seen if only is None else seen & only.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        return count

    found = rows.where("toxic = 1").select("text").mapInArrow(counter(), schema).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bad = {r["term"]: r["n"] for r in found.orderBy(F.desc("n"), "term").limit(20_000).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(bad))
    good = {r["term"]: r["n"] for r in rows.where("toxic = 0").select("text").mapInArrow(counter(shared), schema).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    odds = {t: math.log((n + 0.5) / (toxic + 1)) - math.log((good.get(t, 0) + 0.5) / (clean + 1)) for t, n in bad.items()}
    ranked = sorted((t for t in odds if odds[t] > math.log(4)), key=lambda t: (-odds[t] * math.sqrt(bad[t]), t))
    return {t: odds[t] for t in ranked[:MAX_TERMS]}


def features(docs: DataFrame, terms: dict[str, float], text: str = "text") -> DataFrame:
    """docs with `__features`, the values of FEATURES for each whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        one = Featurizer(shared.value)
        return lambda texts: [[one(t) for t in texts]]

    return append(docs, make, [T.StructField("__features", T.ArrayType(T.DoubleType()))], text)


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True), max_rows: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from at most `max_rows` labelled documents for which learn(doc_id) holds.

    labels: (doc_id, toxic 0/1); other values and null ids are left out, of a
    repeated id the toxic label holds. Disjoint parts of the sample serve the
    lexicon, the trees and the calibration. With one class only (or no row) the
    model is that class' rate.
    """
    rows = _sample(docs, labels, learn, max_rows, doc_id, text)
    terms = _lexicon(rows.where("part = 0"))
    made = materialise(features(rows.where("part > 0").select("part", F.col("toxic").cast("double").alias("label"), "text"), terms).withColumn("features", array_to_vector("__features")).select("part", "label", "features"))
    sizes = {(r["part"], r["label"]): r["count"] for r in made.groupBy("part", "label").count().collect()}
    base = sum(n for (_, y), n in sizes.items() if y == 1) / max(sum(sizes.values()), 1)
    if not all(sizes.get((p, y)) for p in (1, 2) for y in (0.0, 1.0)):
        return Model(terms, base)
    few = made.coalesce(2)  # MAX_LABELLED rows at most: each tree level is one short job
    trees = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, subsamplingRate=0.8, seed=7).fit(few.where("part = 1").select("label", "features"))
    margins = trees.transform(few.where("part = 2")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)
    return Model(terms, base, trees, calibration)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1, higher is likelier toxic) and `predicted` (1 from the threshold on) of each whole text.

    The calibrated value gets a thousandth of the trees' own probability, which
    orders texts that the calibration puts level. Null and empty texts are scored
    by their zero features. Columns named like a new one are replaced, repeated
    rows stay. No shuffle.
    """
    kept = without(docs, ["score", "predicted"])
    if model.trees is None:
        made = docs.select(*[F.col(quoted(c)) for c in kept], F.lit(model.base_rate).alias("score"))
    else:
        rows = features(docs, model.terms, text).withColumn("__vector", array_to_vector("__features"))
        trees = model.trees.copy().setFeaturesCol("__vector").setRawPredictionCol("__raw").setProbabilityCol("__probability").setPredictionCol("__class")
        rows = trees.transform(rows).withColumn("__margin", vector_to_array("__raw")[1]).withColumn("__own", vector_to_array("__probability")[1])
        rows = model.calibration.copy().setFeaturesCol("__margin").setPredictionCol("__calibrated").transform(rows)
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__calibrated"))) * 0.999 + F.col("__own") * 0.001
        made = rows.select(*[F.col(quoted(c)) for c in kept], value.alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
