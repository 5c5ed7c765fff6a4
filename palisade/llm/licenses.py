"""Licence scans by canonical digest, in SQL functions only.

A text's canonical form is its lower-case words: copyright lines ("Copyright (c) 2024 ...", "(c) 2024 ...") and
"all rights reserved" are left out, equivalent spellings are made one, and all but letters and digits counts as
a space. Whole texts, and each of their lines, are joined by the SHA-256 of that form to the digests of
known licences and notices; the known ones are a parameter of the caller, at most ``MOST_KNOWN``, and are broadcast.

A text is read once: its lines get their canonical forms, the whole text's is theirs joined (then the spellings that cross a
line end), and only lines as long as a known form get a digest. What is rare in texts (copyright lines, spellings)
is looked for by plain search before anything is replaced.

NULL and empty texts, and texts or lines of which nothing is left, match nothing. Repeated rows match alike.
If known texts share a digest, the least name stands. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palisade.session import materialise

from .common import text_key, whole_texts

MOST_KNOWN = 10_000

# Spellings that count as one.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "acknowledgement": "acknowledgment",
    "organisation": "organization",
    "authoris": "authoriz",
    "recognis": "recogniz",
    "favour": "favor",
    "judgement": "judgment",
    "wilful": "willful",
    "whilst": "while",
    "per cent": "percent",
    "merchantibility": "merchantability",
    "copyright holder s": "copyright holders",
    "https": "http",
}
COPYRIGHT_LINE = r"(?m)^[ \t*#/;>-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9])|\(c\)[ \t]*(?:copyright|[0-9])|©)[^\n]*$"
RESERVED = r"all rights reserved\.?"
NO_WORD = r"[^\p{L}\p{N}]+"
NO_WORD_IN_LINE = r"[^\p{L}\p{N}\n]+"
# What every match of the patterns above contains.
IN_COPYRIGHT_LINE, IN_RESERVED = ("copyright", "(c)", "©"), ("all rights reserved",)


def _where(df: DataFrame, column: str, holds: Iterable[str], new: Column) -> DataFrame:
    """``column`` replaced by ``new`` in the rows where it holds any of the strings."""
    old = F.col(column)
    return df.withColumn(column, F.when(reduce(Column.__or__, [F.contains(old, F.lit(h)) for h in holds]), new).otherwise(old))


def _spelled(df: DataFrame, column: str, spellings: Mapping[str, str]) -> DataFrame:
    new = F.col(column)
    for one, other in spellings.items():
        new = F.replace(new, F.lit(one), F.lit(other))
    return _where(df, column, spellings, new)


def canonical(df: DataFrame, text: str, lines: str = "lines", form: str = "form") -> DataFrame:
    """``df`` with the canonical forms of a text's lines, empty ones left out, in place of the text, and that of the whole."""
    out = df.withColumn(text, F.lower(text))
    out = _where(out, text, IN_COPYRIGHT_LINE, F.regexp_replace(text, COPYRIGHT_LINE, ""))
    out = _where(out, text, IN_RESERVED, F.regexp_replace(text, RESERVED, ""))
    out = _spelled(out.withColumn(text, F.regexp_replace(text, NO_WORD_IN_LINE, " ")), text, SPELLINGS)
    out = out.withColumn(lines, F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")).drop(text)
    out = out.withColumn(form, F.array_join(lines, " "))
    return _spelled(out, form, {k: v for k, v in SPELLINGS.items() if " " in k})


def _digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(docs: DataFrame, known: Mapping[str, str]) -> DataFrame:
    """digest, length and license_id of the known texts."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    texts = docs.sparkSession.createDataFrame(sorted(known.items()), "license_id string, text string")
    forms = canonical(texts, "text").select(_digest(F.col("form")).alias("digest"), F.length("form").alias("length"), "license_id")
    return forms.groupBy("digest").agg(F.first("length").alias("length"), F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: Mapping[str, str]) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, digest, license_id (of the whole text), and of its lines the number that
    match (n_lines) and the names they match (line_licenses, sorted)."""
    forms = materialise(known_digests(docs, known), "known")
    digests = F.broadcast(forms.select("digest", "license_id"))
    lengths = [r["length"] for r in forms.select("length").distinct().collect()]  # at most MOST_KNOWN
    texts = canonical(whole_texts(docs, text_key().alias("text_key")), "text")
    likely = F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), lambda x: F.sha2(x, 256))
    read = materialise(texts.select("doc_id", "text_key", _digest(F.col("form")).alias("digest"), likely.alias("likely")), "read")
    whole = read.select("doc_id", "text_key", "digest").join(digests, "digest", "left")
    hits = read.select("doc_id", "text_key", F.posexplode("likely").alias("line", "digest")).join(digests, "digest")
    per_text = hits.groupBy("doc_id", "text_key").agg(
        F.count_distinct("line").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses")
    )
    a, b = whole.alias("a"), per_text.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    return a.join(b, same, "left").select(
        "a.doc_id",
        "a.text_key",
        "a.digest",
        "a.license_id",
        F.coalesce("b.n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("b.line_licenses", F.lit("")).alias("line_licenses"),
    )
