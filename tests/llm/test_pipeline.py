"""The whole pipeline, and each stage by itself, against a brute-force account."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import awkward
import corpus_pipeline
import public_tokenizers
import pytest
import test_coding_and_language as coding
import test_exact_and_near as near
import test_mixing as mixing
import tiktoken

from palisade.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark) -> list[tuple]:
    """Documents of the test data with copies, near copies and odd rows among them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()
    rows = [(r.doc_id, r.text[:1500], r.lang, r.source, r.n_chars) for r in docs if r.text is not None]
    one, two = rows[0][1], rows[1][1]
    words = (one + " " + two).split()
    rows += [
        (9001, "  " + one.replace(" ", "\n "), None, "src5", 0),
        (9002, one, "en", None, 0),
        (9003, " ".join(words), None, "src5", 0),
        (9004, " ".join(words) + " end", "de", "src5", 0),
        (9005, None, "en", "src1", 0),
        (9006, "", "en", "src1", 0),
        (9007, "12 34 %%", "en", "src1", 0),
        (9008, "漢字仮名交じり文 🙂", None, "other", None),
        (None, two + " without an id", None, "src2", 5),
    ]
    return rows + rows[2:5]


def code_counts(rows):
    counts = defaultdict(dict)
    for doc_id, text, lang, *_ in rows:
        if None in (doc_id, text, lang) or zlib.crc32(str(doc_id).encode()) % 3 == 1:
            continue
        data = text.encode()
        for i, byte in enumerate(data):
            for k in range(min(language.ORDER, i) + 1):
                seen = counts[lang].setdefault(data[i - k : i], {})
                seen[byte] = seen.get(byte, 0) + 1
    return counts


def read_languages(rows):
    counts = code_counts(rows)
    known, out = {}, []
    for doc_id, text, lang, *rest in rows:
        if not any(map(str.isalpha, text or "")):
            continue
        if text not in known:
            data = text.encode()
            known[text] = min((coding.brute_bits(data, counts[name], language.ORDER) / len(data), name) for name in sorted(counts))
        bits, name = known[text]
        if bits <= corpus_pipeline.MOST_BITS:
            out.append((doc_id, text, lang or name, *rest))
    return out


def first_of_groups(rows, group, rank):
    groups = defaultdict(list)
    for row, g in zip(rows, group, strict=True):
        groups[g].append(row)
    return [min(members, key=rank) for members in groups.values()]


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    return first_of_groups(rows, norm, lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))


def nearly(rows):
    marks = [near.brute_fingerprint(r[1]) for r in rows]
    return first_of_groups(rows, near.brute_groups(marks, 3), lambda r: (r[0] is None, r[0] or 0))


def mixed(rows):
    def domain(source):
        number = re.search("[0-9]{1,9}$", source or "")
        return f"d{int(number[0]) % 4 if number else 0}"

    measured = [(r[0], domain(r[3]), r[2], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    copies = mixing.expected(measured, queries.WEIGHTS, queries.SHARE, queries.EPOCHS, queries.SEED)[1]
    return [row for k, row in enumerate(rows) for _ in range(copies[k])]


def coded(rows):
    judge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coding.RANKS, special_tokens={})
    out = []
    for doc_id, text, *_ in rows:
        ids = judge.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


BRUTE = [read_languages, exact, nearly, mixed, coded]


def test_each_stage_and_the_run(spark, tmp_path):
    rows = fixture(spark)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE, strict=True):
        docs = spark.createDataFrame(rows, SCHEMA)
        out = stage(spark, docs, str(tmp_path))
        left = brute(rows)
        assert 0 < len(left), name
        assert Counter(map(tuple, out.collect())) == Counter(left), name
        rows = left
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(rows)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_awkward_and_empty_tables(spark, stage):
    docs = awkward.frame(spark)
    out = stage[1](spark, docs, "")
    last = stage == corpus_pipeline.STAGES[-1]
    assert out.count() > 0 and (last or out.columns == docs.columns)
    assert stage[1](spark, awkward.empty(spark), "").collect() == []


def test_plain_documents_stay(spark):
    """Neither the language stage nor the two that drop copies touch documents that are neither odd nor alike."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    clean = docs.where("length(text) > 200").dropDuplicates(["text"])
    kept = corpus_pipeline.language_id(spark, clean, "").count()
    assert kept == clean.count()
