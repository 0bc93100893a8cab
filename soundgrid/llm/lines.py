"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines within one edit either share a one-character deletion at the same place
(substitution), or one of them is the other's deletion variant (insertion). Variants
travel as hashed keys; within a key only the earliest line matters, so no pairs are
formed. Only lines that share an untouched half with a line of a fitting length can
have a partner at all, so only those emit variants.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundgrid.llm.texts import quoted, without
from soundgrid.session import materialise

#: Lines with fewer characters go only if they repeat exactly: two short lines within one edit may be different words.
MIN_CHARS = 20
#: Up to so many candidate lines (two numbers each) are broadcast; beyond that they are joined by shuffle.
BROADCAST_LINES = 400_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _halves(line: Column, n: Column) -> Column:
    """Keys of the half that one edit leaves alone, as the longer and as the shorter of two lines."""
    keys = []
    for shorter in (n, n - 1):
        head = F.floor(shorter / 2).cast("int")
        keys += [F.xxhash64(shorter, F.lit(0), F.substring(line, F.lit(1), head)), F.xxhash64(shorter, F.lit(1), F.substring(line, n - (shorter - head) + 1, shorter - head))]
    return F.array(*keys)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line that is long enough: its place (doc, copy, line) and its text with a 128-bit name (h, g)."""
    text = F.col("text")
    lines = docs.select("doc", F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    lines = lines.select("doc", "copy", "line", _trimmed(F.col("raw")).alias("s")).withColumn("n", F.char_length("s")).where(F.col("n") >= min_chars)
    return lines.withColumns({"h": F.xxhash64("s"), "g": F.xxhash64(F.lit("line"), "s")})


def _variants(lines: DataFrame) -> DataFrame:
    """All one-character deletions of lines (h, g, first, s) as (key, place), and the line itself at place 0.

    A key is the xor of hashes of (character, position) over the variant; prefixes
    and suffixes of these come from running windows, linear in the length.
    """
    chars = lines.repartition("h").select("h", "g", "first", F.posexplode(F.split("s", "")).alias("i", "c")).where(F.col("c") != "")
    whole, running = Window.partitionBy("h", "g"), Window.partitionBy("h", "g").orderBy("i")
    here, moved = F.xxhash64("c", "i"), F.xxhash64("c", F.col("i") - 1)
    sums = chars.select(
        "h", "g", "first", "i", here.alias("here"), F.bit_xor(here).over(running).alias("upto"), F.bit_xor(moved).over(running).alias("upto_moved"),
        F.bit_xor(moved).over(whole).alias("all_moved"), F.bit_xor(here).over(whole).alias("all"))
    before, behind = F.col("upto").bitwiseXOR(F.col("here")), F.col("all_moved").bitwiseXOR(F.col("upto_moved"))
    dropped = sums.select("h", "g", "first", (F.col("i") + 1).alias("place"), before.bitwiseXOR(behind).alias("key"))
    return dropped.union(sums.where(F.col("i") == 0).select("h", "g", "first", F.lit(0).alias("place"), F.col("all").alias("key")))


def _earlier(variants: DataFrame) -> DataFrame:
    """(h, g, other): lines that share a variant with an earlier line."""
    me = F.struct("first", "h", "g")
    dealt = variants.repartition("key")
    key, place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    marked = dealt.select(
        "h", "g", "first", "place", F.min(me).over(place).alias("same"), F.min(F.when(F.col("place") == 0, me)).over(key).alias("centre"), F.min(F.when(F.col("place") > 0, me)).over(key).alias("around"))
    others = F.array(F.when(F.col("place") > 0, F.col("same")), F.when(F.col("place") > 0, F.col("centre")).otherwise(F.col("around")))
    found = marked.select("h", "g", "first", F.explode(others).alias("other"))
    return found.where(F.col("other").isNotNull() & (F.col("other")["first"] < F.col("first"))).select("h", "g", F.col("other")["h"].alias("oh"), F.col("other")["g"].alias("og")).distinct()


def kept_lines(docs: DataFrame, min_chars: int = 1, edit_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, copy, keep): line numbers of each document (doc, text) that stay, of lines with `min_chars` characters or more; see dedup()."""
    lines = _occurrences(docs, min_chars)
    place = F.struct("doc", "copy", "line")
    distinct = materialise(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.first(F.when(F.col("n") >= edit_chars, _halves(F.col("s"), F.col("n")))).alias("halves")))
    halves = distinct.select("h", "g", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("least"), F.max("h").alias("most")).where(F.col("least") < F.col("most")).select("half")
    near = materialise(halves.join(shared, "half").select("h", "g").distinct())
    side = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    texts = materialise(lines.join(side, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.min(place).alias("first"), F.min("s").alias("s")))
    links = _earlier(_variants(texts))
    mine, other = texts.select("h", "g", "s"), texts.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("s").alias("os"))
    gone = materialise(links.join(mine, ["h", "g"]).join(other, ["oh", "og"]).where(F.levenshtein("s", "os", 1).between(0, 1)).select("h", "g").distinct())
    stay = distinct.join(gone, ["h", "g"], "left_anti").select("first.*")
    return stay.groupBy("doc", "copy").agg(F.collect_list("line").alias("keep"))


def dedup(docs: DataFrame, min_chars: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their `text` cut to the lines that stay, and `n_lines`, `n_dropped`.

    Lines are ended by a line feed and compared without outer blanks and carriage
    returns. A line goes if an earlier place, by (doc_id, document, line number),
    holds an equal line or one within one character's edit, whether that one stays
    or not. Edits count between lines of MIN_CHARS characters or more, equality
    between all but empty ones; with `min_chars`, shorter lines always stay and
    edits count between all others. Nulls sort first among ids. Rows that repeat whole are one document and get the same lines. A null text
    stays null with no lines, an empty one has one empty line. Columns named like a
    new one are replaced; all others stay.
    """
    kept = without(docs, ["n_lines", "n_dropped"])
    rows = docs.select(*[F.col(quoted(c)) for c in kept])
    slim = rows.select(F.col(quoted(doc_id)).alias("doc"), F.col(quoted(text)).alias("text"))
    least, edit_chars = (1, MIN_CHARS) if min_chars is None else (min_chars, min_chars)
    keep = kept_lines(slim, least, edit_chars).withColumnsRenamed({"doc": "__doc", "copy": "__copy", "keep": "__keep"})
    joined = rows.join(keep, F.col(quoted(doc_id)).eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col(quoted(text))) == F.col("__copy")), "left")
    all_lines = F.split(F.col(quoted(text)), "\n")
    numbers = F.sequence(F.lit(0), F.size(all_lines) - 1)
    short = F.filter(numbers, lambda i: F.char_length(_trimmed(F.element_at(F.col("__lines"), i + 1))) < least)
    joined = joined.withColumn("__lines", all_lines)
    joined = joined.withColumn("__stay", F.array_sort(F.concat(short, F.coalesce("__keep", F.array().cast("array<int>")))))
    cut = F.array_join(F.transform("__stay", lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    known = F.col(quoted(text)).isNotNull()
    return joined.select(
        *[F.when(known, cut).alias(c) if c == text else F.col(quoted(c)) for c in kept],
        F.when(known, F.size("__lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(known, F.size("__lines") - F.size("__stay")).otherwise(0).cast("long").alias("n_dropped"))
