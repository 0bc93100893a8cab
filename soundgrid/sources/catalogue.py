"""Catalogue sources: file kinds, identities, output plans, incremental runs, manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundgrid.functions.rules import violations


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder with their kind by content, never by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def kind(content: Column) -> Column:
    """wav | mp3 | unknown from the first bytes."""

    def at(pos: int, n: int) -> Column:
        return F.hex(F.substring(content, pos, n))

    # RIFF, WAVE and ID3 in ASCII; an MPEG frame starts with eleven set bits.
    wav = (at(1, 4) == "52494646") & (at(9, 4) == "57415645")
    sync = (at(1, 1) == "FF") & (at(2, 1) >= "E0")
    return F.when(wav, "wav").when((at(1, 3) == "494433") | sync, "mp3").otherwise("unknown")


def target_name(path: Column, extension: str) -> Column:
    """File name with its last extension replaced; a leading dot is part of the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(extension))


def output_plan(sources: DataFrame, path: str, folder: Column, extension: str) -> DataFrame:
    """One target per source, with name collisions and overwritten sources marked.

    Collisions are counted by an aggregation and joined back, so one popular name
    does not put its sources into one task.
    """
    d = sources.withColumn("target", F.concat(folder, F.lit("/"), target_name(F.col(path), extension)))
    names = d.groupBy(F.lower("target").alias("_name")).agg(F.count("*").alias("same_name"))
    inputs = sources.select(F.col(path).alias("target"), F.lit(True).alias("_source")).distinct()
    d = d.join(names, F.lower("target") == F.col("_name")).drop("_name").join(inputs, "target", "left")
    return d.withColumn("problem", F.when(F.col("_source"), "replaces_source").when(F.col("same_name") > 1, "name_collision")).drop("_source")


def split_incremental(sources: DataFrame, results: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """todo (no result) | cached (all hashes equal) | stale (a hash differs)."""
    old = results.select(key, *[F.col(h).alias(f"_{h}") for h in hashes], F.lit(True).alias("_has"))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(h).eqNullSafe(F.col(f"_{h}"))
    d = sources.join(old, key, "left")
    return d.withColumn("status", F.when(F.col("_has").isNull(), "todo").when(same, "cached").otherwise("stale")).drop(
        "_has", *[f"_{h}" for h in hashes])


# Licences that allow measurement without review.
PERMISSIONS = ("CC-BY-4.0", "CC-BY-3.0", "user_owned_authorized")


def manifest_errors(entries: DataFrame) -> DataFrame:
    """Columns id, path, role, eligible, permission, artist, source_page -> errors."""
    ids = entries.groupBy("id").agg(F.count("*").alias("_ids"))
    paths = entries.where("path IS NOT NULL").groupBy(F.lower("path").alias("_p")).agg(F.count("*").alias("_paths"))
    d = entries.join(ids, "id", "left").join(paths, F.lower("path") == F.col("_p"), "left")
    rules = [
        ("unsafe_or_duplicate_id", F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$") & (F.col("_ids") == 1)),
        ("not_a_technical_pilot", (F.col("role") == "technical_pilot") & ~F.col("eligible")),
        ("permission_needs_review", F.col("permission").isin(*PERMISSIONS)),
        ("missing_provenance", (F.length("artist") > 0) & (F.length("source_page") > 0)),
        ("duplicate_path", F.coalesce(F.col("_paths"), F.lit(1)) == 1),
    ]
    return d.withColumn("errors", violations(rules)).drop("_ids", "_paths", "_p")
