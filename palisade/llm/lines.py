"""Line dedup, in SQL functions only: lines that many documents share stay in one of them.

A line's key is the line stripped of white space at both ends, A-Z in lower case. Keys of at least ``min_points``
code points found in at least ``min_docs`` documents lose all their lines but those of the largest doc_id that holds
them; all other lines stay, joined by line ends again.

1. Lines are exploded and their keys counted by a 64-bit hash, in the map tasks first. A key in ``min_docs`` documents has
   that many lines, so only lines whose hash comes that often go on, now with a 128-bit digest of the whole key.
2. For each digest, the distinct documents and the largest id. A frequent line is one row of these counts; the
   lines themselves meet them in an equi join whose large side adaptive execution may split.
3. The places of a text's dropped lines, a list no longer than its lines, meet the text; the others are put together
   by position.

NULL and empty texts are one empty line. Documents are told apart by doc_id: rows that share one count once and
keep or lose lines alike; NULL ids count as one document, below all others. Repeated rows come out as often as they go in. An
empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from palisade.session import materialise

from .common import text_key, whole_texts

MIN_POINTS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """``line`` must be a column, as it is read more than once. ASCII has a faster way to lower case."""
    stripped = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, ascii_uppercase, ascii_lowercase))


def exploded(texts: DataFrame, min_points: int) -> DataFrame:
    """doc_id, text_key, pos, hash and digest of every line whose key is long enough."""
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # no stripped line has more code points than bytes
    keys = lines.where(F.octet_length("line") >= min_points).withColumn("line", line_key(F.col("line")))
    keys = keys.where(F.length("line") >= min_points)
    return keys.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("hash"), F.unhex(F.md5("line")).alias("digest"))


def dropped_lines(texts: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, places): the lines that each text loses, counted from 0; one row for each distinct row that loses any."""
    lines = exploded(texts, min_points)
    often = lines.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("hash")
    shared = materialise(lines.join(materialise(often, "often"), "hash").drop("hash"), "shared")
    held = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    keys = shared.groupBy("digest").agg(held.alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= min_docs)
    gone = shared.join(materialise(keys, "frequent"), "digest").where(~F.coalesce(F.col("doc_id") == F.col("last"), F.lit(False)))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("places"))


def _without(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places``. The lines are bound once, not split anew for each of them."""

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    return F.transform(F.array(F.split(text, "\n")), rest)[0]


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_lines (before dropping), n_dropped and text (of the lines that stay)."""
    texts = whole_texts(docs, text_key().alias("text_key"))
    gone = materialise(dropped_lines(texts, min_points, min_docs), "dropped")
    a, b = texts.alias("a"), gone.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    return a.join(b, same, "left").select(
        "a.doc_id",
        "a.text_key",
        (F.octet_length("a.text") - F.octet_length(F.replace("a.text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("b.places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("b.places").isNull(), F.col("a.text")).otherwise(_without(F.col("a.text"), F.col("b.places"))).alias("text"),
    )
