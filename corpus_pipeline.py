"""From raw documents to token ids, in five stages. Each works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return the columns of ``documents``; the last returns the coded texts.
Rows with NULL ids, repeated rows and further columns pass through as the operators' docstrings define; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import exact, language, mixing, queries, simhash
from palisade.llm.common import documents
from palisade.session import materialise

#: A text that no language codes below this many bits a byte (a uniform code takes 8) is rejected.
MOST_BITS = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in no learnt language; missing labels get the predicted one.

    Without any labelled row there is nothing to judge by, and all rows stay.
    """
    trees = language.train(docs.where(language.learnable()).select("doc_id", "lang", "text"))
    if not trees.languages:
        return docs
    read = language.scored(docs, trees).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS))
    named = read.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")))
    return named.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest original stays."""
    return exact.keep_rows(docs, exact.exact_duplicates(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the row of the smallest doc_id stays."""
    groups = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    return exact.keep_rows(docs, groups.groupBy("root").agg(first).select("first.doc_id", "first.text_key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: none, once, or in several epochs."""
    mixed = mixing.mix(docs, queries.domain(), queries.WEIGHTS, queries.SHARE, queries.EPOCHS, queries.SEED)
    return mixing.taken_rows(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again, as counts and digests."""
    return queries.coded(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: The first stage's context trees and the last one's merges have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
