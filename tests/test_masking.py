import json
import random

import hypothesis.strategies as st
import pytest
from compare import plan_of
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F, types as T

from palisade.functions import masking
from palisade.functions.redaction import (
    CREDENTIAL_SECRETS,
    LOG_SECRETS,
    LOG_SECRETS_COMPAT,
    SecretKeys,
    redact_frame,
    redact_headers,
    redact_json,
    redact_keys,
    redact_typed_json,
)
from palisade.operators.vault import detokenize, token_collisions, token_vault


def one(spark, value, strategy, fmt=None, **options):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(masking.mask(F.col("v"), strategy, fmt, **options).alias("m")).first()["m"]


@pytest.mark.parametrize(
    "value, strategy, fmt, options, expected",
    [
        ("hello@test.com", "none", None, {}, "hello@test.com"),
        ("hello@test.com", "redact", None, {}, "***REDACTED***"),
        ("hello@test.com", "hash", None, {"compat": True}, "sha256:5c3f762d"),
        ("hello@test.com", "tokenize", None, {"compat": True}, "tok_5c3f762d"),
        ("hello@test.com", "partial", None, {}, "****.com"),
        ("ab", "partial", None, {}, "****"),
        ("123-45-6789", "partial", "***-**-****", {}, "***-**-6789"),
        ("hello@test.com", "partial", "***@****.***", {}, "***@****.com"),
        ("ab", "partial", "x-****", {}, "x-ab**"),
        ("ab", "partial", "**fixed", {}, "**fixed"),
        ("", "partial", "***", {}, "***"),
        ("", "hash", None, {"compat": True}, "sha256:0"),
        ("polygenelubricants", "hash", None, {"compat": True}, "sha256:80000000"),
    ],
)
def test_vectors(spark, value, strategy, fmt, options, expected):
    assert one(spark, value, strategy, fmt, **options) == expected


@pytest.mark.parametrize("strategy", masking.STRATEGIES)
@pytest.mark.parametrize("fmt", [None, "a-**", "fixed"])
def test_null_stays_null(spark, strategy, fmt):
    assert one(spark, None, strategy, fmt) is None


def test_unknown_strategy():
    with pytest.raises(ValueError):
        masking.mask(F.lit("x"), "rot13")


def model_hash(text: str) -> str:
    h, raw = 0, text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] * 256 + raw[i + 1]) % 2**32
    return format(2**32 - h if h >= 2**31 else h, "x")


def model_partial(text: str, fmt: str) -> str:
    head = fmt.rstrip("*")
    shown = len(fmt) - len(head)
    return head + (text[-shown:] if shown else "").ljust(shown, "*")


TEXTS = st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(TEXTS, min_size=30, max_size=60), fmt=st.text("*-a.", min_size=1, max_size=8))
def test_against_model(spark, values, fmt):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(
        "v", masking.rolling_digest(F.col("v")).alias("h"), masking.partial(F.col("v"), fmt).alias("p")
    ).collect()
    for r in rows:
        assert r["h"] == model_hash(r["v"])
        assert r["p"] == model_partial(r["v"], fmt)


def test_long_text_is_hashed_whole(spark):
    text = "häuser 😀 " * 20_000
    assert one(spark, text, "hash", compat=True) == "sha256:" + model_hash(text)


def test_number_text(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(masking.as_text(F.col("v"), T.DoubleType(), True)).collect()]
    assert got == ["1", "1.5", "NaN"]


def test_mask_frame(spark):
    df = spark.createDataFrame([(1, "alice@test.com", "Alice"), (2, None, "Bob")], "id int, email string, name string")
    policies = [
        {"name": "EMAIL", "masking": "partial", "mask_format": "***@****.***"},
        {"name": "id", "masking": "redact"},
        {"name": "name", "masking": "none"},
        {"name": "ssn", "masking": "redact"},
    ]
    out = masking.mask_frame(df, policies)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [
        ("***REDACTED***", "***@****.com", "Alice"),
        ("***REDACTED***", None, "Bob"),
    ]
    assert masking.mask_frame(df, []) is df


def test_literal_redaction_drops_the_raw_column(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    policy = [{"name": "c_acctbal", "masking": "redact"}]

    def reads(out):
        return out._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]

    assert "c_acctbal" in reads(masking.mask_frame(df, policy))
    assert "c_acctbal" not in reads(masking.mask_frame(df, policy, hide_nulls=True))


def test_vault_round_trip_and_collisions(spark):
    df = spark.createDataFrame([("Aa", 1), ("BB", 2), ("Aa", 3), (None, 4)], "v string, n int")
    vault = token_vault(df, ["v"])
    assert vault.count() == 2
    hidden = df.withColumn("v", masking.token(F.col("v")))
    assert sorted(map(tuple, detokenize(hidden, "v", vault).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str
    )
    assert token_collisions(vault).count() == 0
    weak = token_vault(df, ["v"], compat=True)  # both texts have the same 32-bit hash
    assert [r["values"] for r in token_collisions(weak).collect()] == [2]


# ── nested secrets ─────────────────────────────────────────────────


def test_nested_and_null_secrets(spark):
    schema = "credentials struct<password:string,Token:int>, data struct<ok:boolean>, l array<struct<secret:string>>"
    df = spark.createDataFrame([((None, 7), (True,), [("s",), (None,)])], schema)
    row = redact_frame(df).first()
    assert tuple(row["credentials"]) == ("[REDACTED]", "[REDACTED]")
    assert row["data"]["ok"] is True
    assert [i["secret"] for i in row["l"]] == ["[REDACTED]"] * 2


def test_null_containers_stay_null(spark):
    df = spark.createDataFrame([(None, None)], "a struct<password:string>, m map<string,string>")
    assert tuple(redact_frame(df).first()) == (None, None)


def test_depth_limit(spark):
    def nest(depth):
        dtype = T.StructType([T.StructField("token", T.StringType())])
        value = ("raw",)
        for _ in range(depth):
            dtype, value = T.StructType([T.StructField("n", dtype)]), (value,)
        return dtype, value

    def innermost(depth, keys=LOG_SECRETS):
        dtype, value = nest(depth)
        df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
        out = df.select(redact_keys(F.col("v"), dtype, keys).alias("v")).first()["v"]
        for _ in range(depth):
            out = out["n"]
        return out["token"]

    assert innermost(11) == "[REDACTED]"
    assert innermost(10, LOG_SECRETS_COMPAT) == "[REDACTED]"
    assert innermost(11, LOG_SECRETS_COMPAT) == "raw"


def test_maps(spark):
    df = spark.createDataFrame(
        [({"Authorization": "Bearer x", "Content-Type": "json"}, {"password": 1, "n": 2})],
        "h map<string,string>, m map<string,int>",
    )
    row = df.select(redact_headers(F.col("h")).alias("h"), redact_keys(F.col("m"), df.schema["m"].dataType).alias("m"))
    row = row.first()
    assert row["h"] == {"Authorization": "[REDACTED]", "Content-Type": "json"}
    assert row["m"] == {"password": "[REDACTED]", "n": "2"}


def test_json_text(spark):
    df = spark.createDataFrame([('{"token": null, "a": {"api_key": "x", "n": null}}',)], "j string")
    out = df.select(redact_typed_json(F.col("j"), "token string, a struct<api_key:string,n:int>")).first()[0]
    assert out == '{"token":"[REDACTED]","a":{"api_key":"[REDACTED]","n":null}}'


def redacted(spark, texts, *options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    out = df.select("i", redact_json(F.col("j"), *options).alias("r")).orderBy("i")
    assert "Python" not in plan_of(out)
    return [tuple(r["r"]) for r in out.collect()]


def test_any_json_text(spark):
    texts = ['{"keep":{"a":1},"p\\u0061ssword":{"x":1}}', "not json", None, "[1.5,\"é\",{\"token\":null}]", "", "[" * 20_000]
    assert redacted(spark, texts) == [
        ('{"keep":{"a":1},"p\\u0061ssword":"[REDACTED]"}', True),
        ("not json", False),
        (None, None),
        ('[1.5,"é",{"token":"[REDACTED]"}]', True),
        ("", False),
        (texts[5], False),
    ]


def test_json_text_keeps_every_other_character(spark):
    same = [
        '{"a":"\\ud800", "n": [1e400, -0.0, 12345678901234567890.123456789012345678901234567890, 1E+2]}',
        '{"a":1,"a":2,"a":{"token2":3}}',
        ' \t\r\n"password" ',
        '["token", "password", ":", {"x": "\\"token\\": 1"}]',
        "0",
        '"' + "x" * 100_000 + '\\n"',
        "[" * 3000 + "]" * 3000,
        '{"":{}}',
    ]
    assert redacted(spark, same) == [(t, True) for t in same]
    bad = ["NaN", '{"token":NaN}', "[1,]", '{"token":1,}', "01", "1 2", '{"token" 1}', '{"token":}', "[}", '{"token":1]', '"a', '"\\x"', "\"\x01\"", "tru", "+1", "'a'", "[1", '{"token":[1}', "{1:2}", "{,}", "﻿1", "]"]
    assert redacted(spark, bad) == [(t, False) for t in bad]
    assert redacted(spark, ['{"token" : {"a":[1,{"token":2}]} , "b":2,"Secret":"x","l":[{"api_key":null} ,7]}\n']) == [
        ('{"token" : "[REDACTED]" , "b":2,"Secret":"[REDACTED]","l":[{"api_key":"[REDACTED]"} ,7]}\n', True)
    ]
    assert redacted(spark, [' {"a" : [ 1 , " " ] , "token" : [ 2 ] } '], LOG_SECRETS, True) == [('{"a":[1," "],"token":"[REDACTED]"}', True)]


def test_json_text_against_the_parsed_value(spark):
    """Random texts, whole and damaged, against Python's parser: same verdict, and the cleaned value."""
    rng = random.Random(6)
    keys = ["a", "b", "token", "Password", "x-api-key", "toke", "é"]

    def value(depth):
        kind = rng.randint(0, 7 if depth < 13 else 4)
        if kind < 5:
            return rng.choice([None, True, -1.5, 0, 10**25, "", "token", 'say "token": {', "\\", "🙂 é \n", "[REDACTED]"])
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(keys): value(depth + 1) for _ in range(rng.randint(0, 4))}

    def clean(v, keys, depth=0):
        if keys.max_depth is not None and depth > keys.max_depth:
            return v
        if isinstance(v, dict):
            return {k: keys.replacement if keys.hit(k) else clean(x, keys, depth + 1) for k, x in v.items()}
        return [clean(x, keys, depth + 1) for x in v] if isinstance(v, list) else v

    def refused(name):
        raise ValueError(name)

    texts = []
    for k in range(600):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if k % 3 == 0 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "{", "]", ",", '"', "\\", "1", " ", ":", "x"]) + text[at + rng.randint(0, 1) :]
        texts.append(text)
    for secrets in (LOG_SECRETS, LOG_SECRETS_COMPAT, SecretKeys(("a",), "*\"*", False, 2)):
        for compact in (False, True):
            for raw, (text, parsed) in zip(texts, redacted(spark, texts, secrets, compact), strict=True):
                try:
                    read = json.loads(raw, parse_constant=refused)
                except ValueError:
                    assert (text, parsed) == (raw, False)
                    continue
                assert parsed and json.loads(text) == clean(read, secrets), raw
                if compact:
                    assert text == json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":")) or "\\" in raw


def test_credentials_match_exact_case(spark):
    df = spark.createDataFrame([(("p", "P", "k"),)], "c struct<password:string,PassWord2:string,apiKey:string>")
    assert tuple(redact_frame(df, CREDENTIAL_SECRETS).first()["c"]) == ("***", "P", "***")
