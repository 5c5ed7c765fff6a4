"""Pseudonyms: valid, alike for equal values, one to one. Licences: canonical forms by their digests."""

import datetime
import hashlib
import random
import re

import awkward
import pytest
from pyspark.sql import functions as F

from palisade.llm import license_texts, licenses, pseudonyms


def luhn(text):
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonymised(docs, key)}


def pseudonymised(docs, key):
    return pseudonyms.pseudonymised(docs, key).collect()


def shape(text):
    return re.sub("[0-9]", "9", text)


def test_kinds_keep_their_formats(spark):
    texts = [
        "call +1 (988) 555-2485 or 988-555-2485.",
        "card 4041894974608795 or 4041 8949 7460 8795, not 4041894974608796",
        "amex 3782-822463-10005",
        "ssn 123-45-6789 but not 000-12-3456 or 666-12-3456",
        "born 1984-02-29, 02/29/1984, 31/12/1999, 28.02.1983; not 29.02.1983 or 2024-13-01",
        "DE89370400440532013000 and DE89 3704 0044 0532 0130 00, not DE88370400440532013000",
        "write bosbt.42@mail8.example.com",
        "+49 30 1234567",
        "ip 70.123.182.155. But 4.0. and 1.2.3.400 are none",
    ]
    got = run(spark, texts)
    kinds = [r.kinds for _, r in sorted(got.items())]
    assert kinds == [["phone"] * 2, ["card"] * 2, ["card"], ["ssn"], ["date"] * 4, ["iban"] * 2, ["email"], ["intl"], ["ipv4"]]
    for k, text in enumerate(texts[:8]):
        new = got[k].text
        assert new != text and len(new) == len(text)
        assert re.sub("[A-Za-z0-9]", "x", new) == re.sub("[A-Za-z0-9]", "x", text)
        if k < 5:
            assert shape(new) == shape(text)
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", got[0].text)
    assert len(phones) == 2 and phones[0] == phones[1] and phones[0][0][0] >= "2" <= phones[0][1][0]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[1].text)
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[2] == "4041894974608796"
    assert luhn(got[2].text)
    assert got[3].text.endswith("but not 000-12-3456 or 666-12-3456")
    dates = re.findall(r"\d{4}-\d{2}-\d{2}", got[4].text)
    datetime.date.fromisoformat(dates[0])
    assert dates[0] == datetime.datetime.strptime(re.findall(r"\d{2}/\d{2}/\d{4}", got[4].text)[0], "%m/%d/%Y").date().isoformat()
    assert got[4].text.endswith("not 29.02.1983 or 2024-13-01")
    ibans = re.findall(r"DE\d{2}(?: ?\d{4}){4} ?\d{2}", got[5].text)
    assert ibans[0] == ibans[1].replace(" ", "") and int(ibans[0][4:] + "1314" + ibans[0][2:4]) % 97 == 1
    assert got[5].text.endswith("not DE88370400440532013000")
    assert re.fullmatch(r"write [a-z]{5}\.\d\d@mail8\.example\.com", got[6].text)
    assert re.fullmatch(r"ip (\d{1,3}\.){4} But 4\.0\. and 1\.2\.3\.400 are none", got[8].text)
    assert run(spark, texts, "other")[1].text != got[1].text


def test_an_invalid_match_hides_no_valid_value(spark):
    cases = [
        ("ES9121000418450200051332 EUR 100", "iban", ["ES9121000418450200051332"]),
        ("BE68539007547034 2024-01-02", "iban,date", ["BE68539007547034", "2024-01-02"]),
        ("AT61 1904 3002 3457 3201 BIC", "iban", ["AT61 1904 3002 3457 3201"]),
        ("ID12 4111 1111 1111 1111", "card", ["4111 1111 1111 1111"]),
        ("BE12 4111 1111 1111 1111", "card", ["4111 1111 1111 1111"]),
        ("AT12 DE89 3704 0044 0532 0130 00", "iban", ["DE89 3704 0044 0532 0130 00"]),
        ("1234 5678 4111 1111 1111 1111, then 29.02.1983 and 28.02.1983", "card,date", ["4111 1111 1111 1111", "and 28.02.1983"]),
        ("+49 30 123456 2024-01-02", "intl,date", ["+49 30 123456", "2024-01-02"]),
        ("+49 30 123456 212-555-2485", "intl,phone", ["+49 30 123456", "212-555-2485"]),
        ("+33 1 42 68 53 00", "intl", ["1 42 68 53 00"]),
    ]
    got = run(spark, [text for text, _, _ in cases])
    for k, (text, kinds, hidden) in enumerate(cases):
        assert ",".join(got[k].kinds) == kinds, text
        assert len(got[k].text) == len(text)
        assert not [x for x in hidden if x in got[k].text], text
    assert "29.02.1983" in got[6].text and got[6].text.startswith("1234 5678 ") and got[5].text.startswith("AT12 DE")


def brute_text(text, key, kind, rounds=pseudonyms.ROUNDS):
    def shifted(half, digest):
        out = ""
        for at, c in enumerate(half):
            by = int(digest[at % 64 * 2 :][:2], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + size:
                    c = chr((ord(c) - ord(first) + by) % size + ord(first))
                    break
            out += c
        return out

    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, rounds + 1):
        digest = hashlib.sha512("|".join([key, kind, str(k), right if k % 2 else left, key]).encode()).hexdigest()
        if k % 2:
            left = shifted(left, digest)
        else:
            right = shifted(right, digest)
    return left + right


def test_text_network_is_as_stated_and_one_to_one(spark):
    values = [f"{k:03d}" for k in range(1000)] + ["", "a", "Zz9.-", "x" * 200]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.p for r in frame.select("v", pseudonyms.permute_text(F.col("v"), "k", "t").alias("p")).collect()}
    assert got == {v: brute_text(v, "k", "t") for v in values}
    assert len(set(got.values())) == len(values)


@pytest.mark.parametrize("sizes", [(27, 41), (1, 500), (898, 3)])
def test_pair_network_is_one_to_one(spark, sizes):
    frame = spark.range(sizes[0] * sizes[1]).select((F.col("id") / sizes[1]).cast("long").alias("x"), (F.col("id") % sizes[1]).alias("y"))
    pair = frame.select(pseudonyms.permute_pair(F.col("x"), F.col("y"), sizes, "k", "t").alias("p")).select("p.x", "p.y")
    got = {(r.x, r.y) for r in pair.collect()}
    assert got == {(x, y) for x in range(sizes[0]) for y in range(sizes[1])}


def test_awkward_rows_pass(spark):
    rows = awkward.rows()
    got = pseudonymised(awkward.frame(spark), "k")
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert all(r.kinds == [] for r in got)
    assert pseudonymised(awkward.empty(spark), "k") == []


def test_no_python_in_the_plans(spark):
    docs = awkward.frame(spark)
    for df in (pseudonyms.pseudonymised(docs, "k"), licenses.scan(docs, license_texts.KNOWN)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses(spark):
    mit = license_texts.KNOWN["MIT"]
    texts = [
        "Copyright (c) 2024 A. Person\n\n" + mit,
        "/* " + mit.upper().replace("\n", "\n * ") + " */",
        mit.replace("sublicense", "sub-licence").replace("copyright holders", "copyright holder's"),
        mit + " and more",
        "Some text.\n  released under the MIT licence\nmore\nLicensed under CC BY-NC 4.0!\nReleased under the MIT License",
        "(c) 2020 Nobody\nAll rights reserved.",
        None,
        "",
        "...",
    ]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in licenses.scan(docs, license_texts.KNOWN).collect()}
    assert [got[k].license_id for k in range(9)] == ["MIT", "MIT", "MIT", None, None, None, None, None, None]
    assert (got[4].n_lines, got[4].line_licenses) == (3, "CC-BY-NC-4.0 notice,MIT notice")
    assert [got[k].digest for k in (5, 6, 7, 8)] == [None] * 4
    assert [got[k].n_lines for k in (3, 5, 6, 7, 8)] == [0] * 5


def test_one_pass_makes_the_forms_that_each_text_and_line_has_alone(spark):
    """Against the definition: every replacement on the whole text, and on each line by itself."""
    rng = random.Random(5)
    parts = [*licenses.SPELLINGS, "sub", "license", "licence", "per", "cent", "copyright", "holder", "s", "Copyright (c) 2020 X", "© Y", "(c) 1999 Z", "# Copyright 3"]
    parts += ["All Rights Reserved.", "all rights", "reserved", "ÉTÉ", "über", "\r", "%", "'", "non", "commercial", "a1", "漢字", "İ"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "-", " \n ", "", "\n\n"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def plain(text):
        out = F.regexp_replace(F.regexp_replace(F.lower(text), licenses.COPYRIGHT_LINE, ""), licenses.RESERVED, "")
        out = F.regexp_replace(out, licenses.NO_WORD, " ")
        for one, other in licenses.SPELLINGS.items():
            out = F.replace(out, F.lit(one), F.lit(other))
        return F.trim(out)

    each = df.select("id", plain(F.col("text")).alias("form"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.select("id", "form", F.struct("pos", plain(F.col("line")).alias("line")).alias("line"))
    want = each.groupBy("id", "form").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    want = {r.id: (r.form, [x.line for x in r.lines if x.line]) for r in want.collect()}
    assert {r.id: (r.form, r.lines) for r in licenses.canonical(df, "text").collect()} == want


def test_whole_texts_of_the_common_licenses(spark):
    known = license_texts.KNOWN
    names = "0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GFDL-1.3 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()
    texts = {name: "Copyright (c) 2024 A. Person\n\n" + known[name].upper().replace("\n", "\n# ") for name in names}
    texts["Apache-2.0 (dated)"] = known["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 A. Person")
    texts["GPL-3.0 (terms)"] = known["GPL-3.0"].partition("How to Apply These Terms")[0]
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, known).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts)
    assert licenses.known_digests(docs, known).count() == len(known)


def test_license_scan_of_awkward_rows(spark):
    assert licenses.scan(awkward.frame(spark), license_texts.KNOWN).count() == len(awkward.rows())
    assert licenses.scan(awkward.empty(spark), license_texts.KNOWN).collect() == []
    assert licenses.scan(awkward.frame(spark), {}).where("license_id is not null").collect() == []
    with pytest.raises(ValueError):
        licenses.known_digests(awkward.frame(spark), {str(k): "x" for k in range(licenses.MOST_KNOWN + 1)})
