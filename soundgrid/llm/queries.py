"""Registered queries of the training-data operators, with SQL twins where SQL can express them."""
from __future__ import annotations

import hashlib
import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundgrid.llm import bpe, clusters, decontam, knn, licenses, lines, ngram, order, periods, secretscan, shards, simhash, toxicity
from soundgrid.llm.texts import documents
from soundgrid.session import materialise

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo a number."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 50 == 0, 5)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out.alias("held_out"))
    model = ngram.train(docs.where(~F.col("held_out")), order=3)
    scored = ngram.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shards.assign(documents(spark, sf_dir), 16)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialise(bpe.encode_wide(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY).select("doc_id", "ids"))  # encoded once, read by both passes
    return order.materialise_order(table, F.col("ids"), key=42, width=2, eager=False)[0]


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = decontam.n_hit(F.col("hits"))
    return made.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(documents(spark, sf_dir))
    return made.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_fuzzy"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=lambda doc_id: remainder(doc_id, 4) != 2)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.when(h % 10 == 0, periods.repeated(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))
    made = periods.collapse(documents(spark, sf_dir).select("doc_id", text.alias("text")))
    best, lines_of = F.col("strongest"), F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(lines_of, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secretscan.scan(documents(spark, sf_dir))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*[r.kind for r in secretscan.BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secretscan.BASE]
    return made.select("doc_id", *counts, F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, centroids = clusters.assign(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = clusters.inertias(made)
    digests = {c: hashlib.sha256(",".join(map(str, map(int, v))).encode()).hexdigest() for c, v in enumerate(centroids)}

    def of(values: dict, kind: str):
        found = F.lit(None).cast(kind)
        for c, value in values.items():
            found = F.when(F.col("cluster") == c, F.lit(value).cast(kind)).otherwise(found)
        return found

    return made.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
places AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT row, p, h.n, item_id FROM (SELECT row, p, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM places) h JOIN windows USING (win)),
words AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS place FROM found) GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""


def _secrets_sql() -> str:
    def kind(rank: int, r: secretscan.Rule) -> str:
        rx = r.pattern.replace("'", "''")
        cut = f"string_split_regex(text, '{rx}') AS before, regexp_extract_all(text, '{rx}', 0) AS found, regexp_extract_all(text, '{rx}', {r.group}) AS part"
        return f"SELECT row, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, {cut} FROM d WHERE regexp_matches(text, '{rx}')"

    count = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secretscan.BASE)
    counted = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secretscan.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kind(i, r) for i, r in enumerate(secretscan.RULES))}),
p AS (SELECT *, unnest(range(1, len(found) + 1)) AS nth FROM m),
s AS (
  SELECT row, kind, rank, list_sum(list_transform(before[1 : nth], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : nth - 1], lambda x: length(x))), 0) AS start, length(found[nth]) AS size
  FROM p WHERE length(part[nth]) >= least),
g AS (
  SELECT row, {counted}, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) AS spans,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < {len(secretscan.BASE)}) AS base
  FROM s GROUP BY row)
SELECT doc_id, {count}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    def assigned(r: int) -> str:
        far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"a{r} AS MATERIALIZED (SELECT row, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT row, vec_id, v, cluster, {far} AS d FROM e, c{r}) GROUP BY row, vec_id, v)"

    def moved(r: int) -> str:
        mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        sums = f"SELECT cluster, nth, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS nth FROM a{r - 1}) GROUP BY cluster, nth"
        return f"c{r} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN (SELECT cluster, list({mean} ORDER BY nth) AS c FROM ({sums}) GROUP BY cluster) m USING (cluster))"

    steps = [assigned(0)]
    for r in range(1, rounds + 1):
        steps += [moved(r), assigned(r)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM e ORDER BY h, v LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


def queries() -> dict:
    ops = [op1_voronoi_knn, op2_kneser_ney, op3_bpe, op4_minimax_shards, op5_training_order, op6_decontamination, op7_simhash, op8_license_scan, op9_line_dedup, op10_toxicity, op11_periodic_runs, op12_secret_scan, op13_centroid_clustering]
    return {f.__name__: f for f in [*ops, pipeline]}


def oracle_sql() -> dict[str, str]:
    own = {"op1_voronoi_knn": OP1_SQL, "op6_decontamination": OP6_SQL, "op12_secret_scan": _secrets_sql(), "op13_centroid_clustering": _clusters_sql()}
    if sql := importlib.import_module("corpus_pipeline").ORACLE_SQL:
        own["pipeline"] = sql
    return own
