"""Language identification by prediction by partial matching (PPM).

Every language gets a byte context tree of orders 0 to ``ORDER``. A byte seen in the longest known context
costs ``-log2(n / (T + D))`` bits, where T counts the context's bytes and D its distinct ones; another byte
costs the escape ``-log2(D / (T + D))`` and is then coded in the next shorter context, at last uniformly.
The statistics are frozen after training, so a text's code length is an exact sum over its bytes, and the
language of least length is predicted.

Trees are trained on a bounded sample of the labelled rows: ``SAMPLE_ROWS`` texts and ``SAMPLE_BYTES`` bytes
of each language, in the order of a hash of doc_id. Labels, sources and ids are no inputs of a prediction.

NULL texts and texts without a letter are ``und`` with score 0 and no code length; ties go to the first
language in order of name. Repeated rows are predicted alike. Without any labelled row all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import HashTable, bytes_of, steps

ORDER = 3
SAMPLE_ROWS = 400
SAMPLE_BYTES = 2_000_000
#: Labels are names of languages: more than this many distinct ones is an error, not a model.
MOST_LANGUAGES = 1000

UNKNOWN = "und"
#: Bytes of text scored at once; the tables of a step take about 100 times as much.
STEP = 1 << 18


def _codes(data: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each order's code of (context, byte) at every place, and whether the context lies within the text."""
    depth = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    code = data.astype(np.int64)
    yield code, np.ones(len(data), bool)
    for k in range(1, order + 1):
        code = code.copy()
        code[k:] |= data[:-k].astype(np.int64) << (8 * k)
        yield code, depth >= k


@dataclass
class Trees:
    """Frozen statistics as tables: bits of each known (context, byte), bits of each known context's escape."""

    languages: list[str]
    bits: list[np.ndarray]  # of each order: a row for each known code, a column for each language
    grams: list[HashTable]
    escapes: list[np.ndarray]
    contexts: list[HashTable]

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        total = np.zeros((len(data), len(self.languages)), np.float32)
        codes = list(_codes(data, starts, len(self.bits) - 1))
        left = np.arange(len(data))
        for k in range(len(self.bits) - 1, 0, -1):
            code, within = codes[k]
            inside = within[left]
            here, skip = left[inside], left[~inside]
            place = self.grams[k].find(code[here])
            known = place >= 0
            total[here[known]] += self.bits[k][place[known]]
            rest = here[~known]
            total[rest] += self.escapes[k][self.contexts[k].find(code[rest] >> 8)]  # the last row, of -1, is 0
            left = np.concatenate([rest, skip])
        total[left] += self.bits[0][codes[0][0][left]]
        out = np.zeros((len(starts) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            out[full] = np.add.reduceat(total, starts[:-1][full], axis=0, dtype=np.float64)
        return out


def _trees(languages: list[str], order: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trees:
    """rows: of each order, the codes with their language's number and their count."""
    wide = len(languages)
    bits, grams, escapes, contexts = [], [], [], []
    for k in range(order + 1):
        code, language, n = rows[k]
        known = np.arange(256) if k == 0 else np.unique(code)
        count = np.zeros((len(known), wide))
        count[np.searchsorted(known, code), language] = n
        context, inverse = np.unique(known >> 8, return_inverse=True)
        total, distinct = np.zeros((len(context), wide)), np.zeros((len(context), wide))
        np.add.at(total, inverse, count)
        np.add.at(distinct, inverse, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            seen = -np.log2(count / (total + distinct)[inverse])
        lower = np.full((256, wide), 8.0) if k == 0 else bits[k - 1][grams[k - 1].find(known & ((1 << 8 * k) - 1))]
        bits.append(np.where(count > 0, seen, escape[inverse] + lower).astype(np.float32))
        grams.append(HashTable(known))
        escapes.append(np.vstack([escape, np.zeros(wide)]).astype(np.float32))
        contexts.append(HashTable(context))
    return Trees(languages, bits, grams, escapes, contexts)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The training texts: (lang, text), at most ``rows`` rows and ``most_bytes`` bytes of each language.

    A share of each language twice as large as needed is drawn by hash first, so that the ranking that
    follows sees about ``2 * rows`` rows of a language however many there are.
    """
    chance = (F.xxhash64("doc_id", F.lit("sample")) % F.lit(1 << 20) + F.lit(1 << 20)) % F.lit(1 << 20)
    known = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text", chance.alias("_at"))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 20, ((2 * rows + 50) << 20) // r["count"] + 1))])
    order = Window.partitionBy("lang").orderBy("_at", "doc_id", F.xxhash64("text"))
    drawn = known.where(F.col("_at") < share[F.col("lang")]).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= rows)
    held = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return drawn.withColumn("_held", F.coalesce(held, F.lit(0))).where(F.col("_held") < most_bytes).select("lang", "text")


def train(labelled: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Trees:
    """Context trees of the languages in ``lang``. Spark counts; the driver gets counts of the bounded sample."""

    def count(batches):
        for part in steps(batches):
            languages = part.column("lang").to_pylist()
            names = sorted(set(languages))
            each = np.array([names.index(x) for x in languages])
            data, starts = bytes_of(part.column("text"))
            number = np.repeat(each, np.diff(starts))
            for k, (code, within) in enumerate(_codes(data, starts, order)):
                both, n = np.unique(number[within] << 40 | code[within], return_counts=True)
                tags = pa.array([names[x] for x in (both >> 40).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [tags, pa.array(np.full(len(both), k, np.int32)), pa.array(both & ((1 << 40) - 1)), pa.array(n.astype(np.int64))],
                    ["lang", "k", "code", "n"],
                )

    counted = sample(labelled, rows, most_bytes).mapInArrow(count, "lang string, k int, code long, n long")
    found = counted.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    place = {name: at for at, name in enumerate(names)}
    language = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    k, code, n = (found.column(c).to_numpy() for c in ("k", "code", "n"))
    return _trees(names, order, [(code[k == at], language[k == at], n[k == at]) for at in range(order + 1)])


def _predicted(docs: DataFrame, trees: Trees, row: Column, with_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(row.alias("row"), F.col("text").alias("text"))

    def task(batches):
        trees = shared.value
        for part in steps(batches, STEP):
            texts = part.column("text")
            ok = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool) & bool(trees.languages)
            names, score, rate = [UNKNOWN] * len(ok), np.zeros(len(ok)), np.zeros(len(ok))
            if ok.any():
                data, starts = bytes_of(texts.fill_null(""))
                bits = trees.lengths(data, starts)
                least = bits.min(1)
                names = [trees.languages[b] if x else UNKNOWN for b, x in zip(bits.argmin(1), ok, strict=True)]
                score = np.where(ok, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
                rate = least / np.maximum(np.diff(starts), 1)
            found = [pa.array(names, pa.string()), pa.array(score), pa.array(rate, mask=~ok)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *[texts] * with_text, *found], schema.fieldNames())

    schema = rows.select("row", *["text"] * with_text).schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(task, schema)


def predict(docs: DataFrame, trees: Trees, *keep: Column) -> DataFrame:
    """The columns ``keep``, then lang_pred, score (posterior of the language) and bits_per_byte of every row's whole text."""
    return _predicted(docs, trees, F.struct(*keep), False).select("row.*", "lang_pred", "score", "bits_per_byte")


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """Every row's columns but its text in ``row``, then text, lang_pred, score and bits_per_byte."""
    return _predicted(docs, trees, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]), True)


def learnable() -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
