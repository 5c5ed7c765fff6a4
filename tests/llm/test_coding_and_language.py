"""Byte-level BPE against the reference library; language identification on held-out rows."""

import itertools
import random

import awkward
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from palisade.llm import bpe, language

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SPLIT = regex.compile(public_tokenizers.PATTERN).findall


@pytest.fixture(scope="module")
def judge():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS)


def strange() -> list[str]:
    random.seed(2)
    pool = [chr(c) for c in [*range(32, 127), *range(160, 1500), *range(0x4E00, 0x4E80), 0x1F600, 0x200B, 0x85, 0x1C, 9, 10, 13, 0]]
    fixed = ["", " ", "  ", "a  b", "a \n b", "it's 'S we'll  ''s", "\0 a b", "trail ", " lead", "a" * 3000, "ab" * 900, " " * 700 + "b", "é" * 600]
    return fixed + ["".join(random.choice(pool) for _ in range(random.randint(1, 200))) for _ in range(200)]


def test_ids_of_strange_texts(judge, vocabulary):
    memory = bpe._Memory(vocabulary, SPLIT)
    texts = strange()
    cuts = [bpe.cut(t, SPLIT) for t in texts]
    places = memory.places(list(itertools.chain.from_iterable(cuts)))
    at = 0
    for text, cut in zip(texts, cuts, strict=True):
        ids = [i for p in places[at : at + len(cut)] for i in memory.flat[memory.start[p] : memory.start[p] + memory.length[p]].tolist()]
        at += len(cut)
        assert ids == judge.encode_ordinary(text), text[:40]


@pytest.mark.parametrize("seed", range(8))
def test_a_space_at_the_start_among_ordinary_texts(judge, vocabulary, seed):
    words = "the of and der die das ist la le les 12 foo's (x) y".split()
    texts = [" lead", " lead again", "plain", *(f"{a} {b}{k}" for k, (a, b) in enumerate(itertools.permutations(words, 2)))]
    random.Random(seed).shuffle(texts)
    cuts = [bpe.cut(t, SPLIT) for t in texts]
    stretches = list(dict.fromkeys(itertools.chain.from_iterable(cuts)))
    random.Random(seed).shuffle(stretches)
    memory = bpe._Memory(vocabulary, SPLIT)
    memory._learn(stretches)
    for text, cut in zip(texts, cuts, strict=True):
        ids = [i for p in memory.places(cut) for i in memory.flat[memory.start[p] : memory.start[p] + memory.length[p]].tolist()]
        assert ids == judge.encode_ordinary(text)
    assert "" not in stretches


def test_empty_stretches_are_refused(vocabulary):
    with pytest.raises(ValueError):
        bpe._Memory(vocabulary, SPLIT)._split(["foo", "", " bar"])


def test_memory_forgets_without_harm(judge, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    memory = bpe._Memory(vocabulary, SPLIT)
    for text in strange()[13:60]:
        cut = bpe.cut(text, SPLIT)
        ids = [i for p in memory.places(cut) for i in memory.flat[memory.start[p] : memory.start[p] + memory.length[p]].tolist()]
        assert ids == judge.encode_ordinary(text)


def test_round_trip_on_spark(spark, judge):
    coded = bpe.encode(awkward.frame(spark), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(coded, RANKS).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    expected = [(i, judge.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in awkward.rows()]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(expected, key=key)
    empty = bpe.decode(bpe.encode(awkward.empty(spark), RANKS, public_tokenizers.PATTERN), RANKS)
    assert empty.collect() == []


def brute_bits(text: bytes, counts: dict, order: int) -> float:
    """Code length of a text, byte by byte, from counts[context][byte]."""
    bits = 0.0
    for i, byte in enumerate(text):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if byte in seen:
                bits -= np.log2(seen[byte] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    random.seed(4)
    rows = [(k, "".join(random.choice("abcd é" if k % 2 else "cdefü ") for _ in range(50)), "xy"[k % 2]) for k in range(40)]
    trees = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.languages == ["x", "y"]
    counts = [{}, {}]
    for _, text, lang in rows:
        data = text.encode()
        for i, byte in enumerate(data):
            for k in range(min(language.ORDER, i) + 1):
                seen = counts["xy".index(lang)].setdefault(data[i - k : i], {})
                seen[byte] = seen.get(byte, 0) + 1
    texts = ["", "a", "abc abc", "zz", "cé\0ü", "e" * 300, *(t for _, t, _ in rows[:6])]
    data = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(t) for t in data]))
    got = trees.lengths(np.frombuffer(b"".join(data), np.uint8), starts)
    expected = [[brute_bits(t, c, language.ORDER) for c in counts] for t in data]
    np.testing.assert_allclose(got, expected, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language.train(docs.where(language.learnable()).select("doc_id", "lang", "text"))
    from pyspark.sql import functions as F

    found = language.predict(docs.where(~language.learnable()), trees, F.col("lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = awkward.frame(spark)
    trees = language.train(docs.where(language.learnable()).select("doc_id", "lang", "text"))
    got = language.predict(docs, trees, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(awkward.rows())
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == language.UNKNOWN) == (not letters)
        assert letters or (r.score == 0 and r.bits_per_byte is None)
    nothing = language.train(awkward.empty(spark).select("doc_id", "lang", "text"))
    assert nothing.languages == []
    assert {r.lang_pred for r in language.predict(docs, nothing, F.col("doc_id")).collect()} == {language.UNKNOWN}
    assert language.predict(awkward.empty(spark), trees, F.col("doc_id")).collect() == []


def test_sample_is_bounded(spark):
    rows = [(k, "abc " * 10, "en" if k % 3 else "de") for k in range(600)]
    drawn = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20, most_bytes=200)
    held = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert held == {"en": 5, "de": 5}


def test_there_and_back_in_one_worker(spark):
    """Both ways in one Python step, with the rows of the two operators one after the other."""
    docs = spark.createDataFrame([(1, "plain words, twice twice"), (2, None), (3, ""), (None, "ä😀 x"), (1, "plain words, twice twice")], "doc_id long, text string")
    both = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(bytes(r["decoded"]).decode() for r in both.collect()) == ["", "", "plain words, twice twice", "plain words, twice twice", "ä😀 x"]
