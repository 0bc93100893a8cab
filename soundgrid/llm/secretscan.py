"""Secret scan by a trigram inverted index, in DataFrame functions alone.

The Boolean trigram queries of all rules name the trigrams that matter. The index has
the texts of each of these trigrams; a rule's candidates are the texts that stand
under all trigrams of one of its alternatives. Only these are matched against the
rule. Rules without mandatory trigrams read all texts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundgrid.llm import trigrams
from soundgrid.session import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern that Python and Java read alike, and the characters that its group must have at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Three basic kinds, then public token formats. The least length of plain runs stands in their pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("url_login", r"(https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^/:@\x20\x09-\x0D]{1,64}:[^/@\x20\x09-\x0D]{1,128}@"),
    Rule("bearer", r"(?i)bearer\x20[A-Za-z0-9._~+/-]{20,}"),
)


#: Places of the index that hold the postings of one trigram.
SPLIT = 64


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own, whole = F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(own.alias("doc_id"), whole.alias("text"), F.xxhash64(own, whole).alias("k1"), F.xxhash64(F.lit("row"), own, whole).alias("k2"))


def index(docs: DataFrame, wanted: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (trigram, k1, k2) of the wanted trigrams over lowered texts; (k1, k2) names a row by its id and text.

    One pass takes the stretches that could be wanted by their three characters and
    keeps the wanted ones. A trigram's postings lie sorted in SPLIT places at most.
    """
    low = _keyed(docs, doc_id, text).where("text <> ''").select("k1", "k2", F.lower("text").alias("low"))
    sets = ["".join(re.escape(c) for c in sorted({g[i] for g in wanted})) for i in range(3)]
    found = F.array_intersect(F.regexp_extract_all("low", F.lit("(?=([{}][{}][{}]))".format(*sets)), F.lit(1)), F.lit(wanted))
    return materialise(low.select(F.explode(found).alias("trigram"), "k1", "k2").repartition("trigram", F.pmod("k1", F.lit(SPLIT))).sortWithinPartitions("trigram", "k1"))


def candidates(postings: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(k1, k2, kinds): rows that stand under all trigrams of an alternative of a kind's query."""
    rows = [(g, kind, number, 1 << place, (1 << len(a)) - 1) for kind, alternatives in queries.items() for number, a in enumerate(alternatives) for place, g in enumerate(a)]
    plan = F.broadcast(_table(postings.sparkSession, rows, ["trigram", "kind", "alternative", "bit", "all"]).withColumns({c: F.col(f"`{c}`").cast("long") for c in ("bit", "all")}))
    met = postings.join(plan, "trigram").groupBy("k1", "k2", "kind", "alternative").agg(F.bit_or("bit").alias("met"), F.first("all").alias("all"))
    return met.where(F.col("met") == F.col("all")).groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def _matched(rows: DataFrame, rules: list[Rule], applies) -> DataFrame:
    """(k1, k2, kind, least, gaps): for each rule that applies, the lengths of all matches and of what stands before them."""

    def lengths(r: Rule) -> Column:
        size = lambda x: F.char_length(x)
        zipped = F.arrays_zip(F.split("text", r.pattern, -1).alias("before"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"))
        return F.transform(zipped, lambda x: F.struct(size(x["before"]).alias("before"), size(x["match"]).alias("size"), size(x["part"]).alias("part")))

    found = [F.when(applies(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), lengths(r).alias("gaps"))) for r in rules]
    return rows.select("k1", "k2", F.explode(F.array_compact(F.array(*found))).alias("m")).select("k1", "k2", "m.*").where(F.size("gaps") > 1)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): a row per row of docs, with the spans (start, rank, kind, end) of all secrets in its whole text, by start, then by the rules' order.

    Matches of one rule are leftmost and don't overlap; those whose group is too short
    are left out after that. Positions count code points, the end is exclusive. Null
    and empty texts have no spans. Rows with equal id and text are matched once and
    each get the result; other columns are ignored.
    """
    spark = docs.sparkSession
    queries = {r.kind: trigrams.query(r.pattern) for r in rules}
    indexed, full = [r for r in rules if queries[r.kind]], [r for r in rules if not queries[r.kind]]
    keyed = _keyed(docs, doc_id, text)
    parts = []
    if full:
        parts.append(_matched(keyed, full, lambda r: F.col("text").rlike(r.pattern)))
    if indexed:
        queries = {r.kind: queries[r.kind] for r in indexed}
        postings = index(docs, sorted({g for q in queries.values() for a in q for g in a}), doc_id, text)
        chosen = materialise(candidates(postings, queries))
        parts.append(_matched(keyed.join(chosen, ["k1", "k2"]), indexed, lambda r: F.array_contains("kinds", F.lit(r.kind))))
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    found = found.dropDuplicates(["k1", "k2", "kind"])
    pieces = found.select("k1", "k2", "kind", "least", F.posexplode("gaps").alias("at", "gap")).select("k1", "k2", "kind", "least", "at", "gap.*")
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = pieces.withColumn("end", F.sum(F.col("before") + F.coalesce("size", F.lit(0))).over(so_far)).where(F.col("part") >= F.col("least"))
    rank = F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(rules) for v in (r.kind, i)]), F.col("kind"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), rank.alias("rank"), "kind", "end")
    spans = whole.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return keyed.select("doc_id", "k1", "k2").join(spans, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def listed(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
