"""Secret removal inside nested data, by walking the schema."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class SecretKeys:
    names: tuple[str, ...]
    replacement: str
    any_case: bool
    max_depth: int | None  # containers nested deeper than this stay as they are

    def hit(self, name: str) -> bool:
        return (name.lower() if self.any_case else name) in self.names

    def hit_column(self, key: Column) -> Column:
        return (F.lower(key) if self.any_case else key).isin(*self.names)


# Keys whose values are secrets in request logs and headers.
LOG_SECRETS = SecretKeys(
    names=(
        "password",
        "apikey",
        "api_key",
        "secret",
        "token",
        "authorization",
        "x-api-key",
        "x-auth-token",
    ),
    replacement="[REDACTED]",
    any_case=True,
    max_depth=None,
)
# Fixed value: the depth below which logs written in compatibility mode stay as they are.
LOG_SECRETS_COMPAT = replace(LOG_SECRETS, max_depth=10)
# Keys hidden when source definitions are listed.
CREDENTIAL_SECRETS = SecretKeys(names=("password", "apiKey"), replacement="***", any_case=False, max_depth=None)


def redact_keys(value: Column, dtype: T.DataType, keys: SecretKeys = LOG_SECRETS, depth: int = 0) -> Column:
    """Replace the value under every secret key, even a NULL one, in structs, arrays and maps.

    A replaced value is a string. A map has one value type, so a map with secret keys whose
    values are not strings comes back with its other values as JSON text.
    """
    if keys.max_depth is not None and depth > keys.max_depth:
        return value
    if isinstance(dtype, T.StructType):
        parts = []
        for field in dtype.fields:
            if keys.hit(field.name):
                part = F.lit(keys.replacement)
            else:
                part = redact_keys(value.getField(field.name), field.dataType, keys, depth + 1)
            parts.append(part.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        if not _has_container(dtype.elementType):
            return value
        return F.transform(value, lambda v: redact_keys(v, dtype.elementType, keys, depth + 1))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda k, v: _map_value(k, v, dtype.valueType, keys, depth))
    return value


def _map_value(key: Column, value: Column, dtype: T.DataType, keys: SecretKeys, depth: int) -> Column:
    clean = redact_keys(value, dtype, keys, depth + 1)
    if _has_container(dtype):
        clean = F.to_json(clean)
    elif not isinstance(dtype, T.StringType):
        clean = clean.cast("string")
    return F.when(keys.hit_column(key), F.lit(keys.replacement)).otherwise(clean)


def _has_container(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def redact_headers(headers: Column, keys: SecretKeys = LOG_SECRETS) -> Column:
    """Flat map<string,string>: hide the values of secret headers."""
    return F.transform_values(
        headers, lambda k, v: F.when(keys.hit_column(k), F.lit(keys.replacement)).otherwise(v)
    )


# The tokens of JSON; any other character is a token of its own.
_TOKEN = (
    r'[ \t\n\r]++|"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
    r"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|(?s:.)"
)
# What may follow: state, innermost container (- for none), kind of token, next state. States: a value (V), or the end of
# an array too (A); a key (K), or the end of an object too (O); a colon (C); the end of a value (E). Kinds: white space w,
# string s, secret string k, other scalar v, a character out of place ?, and the six signs themselves.
_STEPS = " ".join(
    [f"V{top}{kind}{then}" for top in "-{[" for kind, then in zip("vsk{[", "EEEOA", strict=True)]
    + [f"A[{kind}{then}" for kind, then in zip("vsk{[]", "EEEOAE", strict=True)]
    + [f"{state}{{{kind}C" for state in "KO" for kind in "sk"]
    + ["O{}E", "C{:V", "E{,K", "E{}E", "E[,V", "E[]E"]
)
_SPANS = "array<struct<start:int,end:int>>"


def _kind(token: Column, keys: SecretKeys) -> Column:
    first, name = F.substring(token, 1, 1), F.substring(token, F.lit(2), F.length(token) - 2)
    plain = F.when(F.contains(token, F.lit("\\")), F.from_json(F.concat(F.lit('{"k":'), token, F.lit("}")), "k string")["k"]).otherwise(name)
    return (
        F.when(first.isin(*"{}[]:,"), first)
        .when(first == '"', F.when(F.length(token) == 1, "?").when(keys.hit_column(plain), "k").otherwise("s"))
        .when(first.isin(*" \t\n\r"), "w")
        .when((F.length(token) > 1) | first.between("0", "9"), "v")
        .otherwise("?")
    )


def _secret_spans(kinds: Column, keys: SecretKeys) -> Column:
    """First and last token of each value under a secret key, in order; NULL if the tokens are not JSON."""
    state = {"stack": F.lit("-"), "expect": F.lit("V"), "secret": F.lit(False), "hide": F.lit(-1), "start": F.lit(-1), "i": F.lit(0)}
    state["spans"] = F.array().cast(_SPANS)

    def with_next(old: Column, kind: Column) -> Column:
        at = F.instr(F.lit(_STEPS), F.concat(old["expect"], F.substring(old["stack"], -1, 1), kind))
        then = F.when(kind == "w", old["expect"]).when(at > 0, F.substring(F.lit(_STEPS), at + 3, F.lit(1))).otherwise("X")
        return F.struct(old.alias("old"), kind.alias("kind"), then.alias("then"))

    def merge(old: Column, kind: Column) -> Column:
        return F.transform(F.array(with_next(old, kind)), moved)[0]

    def moved(x: Column) -> Column:
        old, kind, then = x["old"], x["kind"], x["then"]
        size, blank = F.length(old["stack"]), kind == "w"
        stack = F.when(kind.isin("{", "["), F.concat(old["stack"], kind)).when(kind.isin("}", "]"), F.substring(old["stack"], F.lit(1), size - 1))
        opens = (old["expect"] == "V") & old["secret"] & (old["hide"] < 0) & ~blank
        if keys.max_depth is not None:
            opens = opens & (size - 2 <= keys.max_depth)
        hide, start = F.when(opens, size).otherwise(old["hide"]), F.when(opens, old["i"]).otherwise(old["start"])
        left = F.when(kind.isin("{", "["), size + 1).when(kind.isin("}", "]"), size - 1).otherwise(size)
        closes = (then == "E") & ~blank & (hide == left)
        span = F.array(F.struct(start.alias("start"), old["i"].alias("end"))).cast(_SPANS)
        return F.struct(
            F.coalesce(stack, old["stack"]).alias("stack"),
            then.alias("expect"),
            F.when(blank | (kind == ":"), old["secret"]).otherwise((then == "C") & (kind == "k")).alias("secret"),
            F.when(closes, -1).otherwise(hide).alias("hide"),
            start.alias("start"),
            (old["i"] + 1).alias("i"),
            F.when(closes, F.concat(old["spans"], span)).otherwise(old["spans"]).alias("spans"),
        )

    def finish(end: Column) -> Column:
        return F.when((end["expect"] == "E") & (end["stack"] == "-"), end["spans"])

    return F.aggregate(kinds, F.struct(*[v.alias(k) for k, v in state.items()]), merge, finish)


def _without_spans(text: Column, x: Column, replacement: str, compact: bool) -> Column:
    """The tokens beside the spans and, in place of each span, the replacement: twice the place tells the one, and one more the other."""
    places = F.sequence(F.lit(0), F.size(x["tokens"]) - 1)
    hidden = F.flatten(F.transform(x["spans"], lambda s: F.sequence(s["start"], s["end"])))
    if compact:
        hidden = F.concat(hidden, F.filter(places, lambda k: F.get(x["kinds"], k) == "w"))
    kept = F.transform(F.array_except(places, hidden), lambda k: 2 * k + 1)
    order = F.sort_array(F.concat(kept, F.transform(x["spans"], lambda s: 2 * s["start"])))
    new = F.lit(json.dumps(replacement, ensure_ascii=False))
    joined = F.array_join(F.transform(order, lambda k: F.when(k % 2 == 0, new).otherwise(F.get(x["tokens"], F.shiftright(k, 1)))), "")
    as_is = x["spans"].isNull() if compact else x["spans"].isNull() | (F.size(x["spans"]) == 0)
    return F.when(as_is, text).otherwise(joined)


def redact_json(text: Column, keys: SecretKeys = LOG_SECRETS, compact: bool = False) -> Column:
    """Secret removal inside JSON texts of any shape: struct<text, parsed>.

    The values under secret keys are replaced, whatever they hold and however deep they sit; every other character stays as it
    is: numbers of any size, repeated keys, escapes. Keys compare without their escapes. ``compact`` leaves out white space
    between tokens. A text that is not JSON comes back as it is, with ``parsed`` false; NULL stays NULL.

    The text is cut into tokens once, and one fold over their kinds, with a stack of open containers, finds the spans to
    replace: built-in expressions only.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def named(tokens: Column) -> Column:
        return F.struct(tokens.alias("tokens"), F.transform(tokens, lambda t: _kind(t, keys)).alias("kinds"))

    def found(x: Column) -> Column:
        return F.struct(x["tokens"].alias("tokens"), x["kinds"].alias("kinds"), _secret_spans(x["kinds"], keys).alias("spans"))

    def shown(x: Column) -> Column:
        return F.struct(_without_spans(text, x, keys.replacement, compact).alias("text"), x["spans"].isNotNull().alias("parsed"))

    # each step is bound to a variable, so that it is worked out once
    result = F.transform(F.transform(F.transform(F.array(tokens), named), found), shown)[0]
    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("parsed"))
    return F.when(text.isNull(), nothing).otherwise(result)


def redact_typed_json(text: Column, schema: T.DataType | str, keys: SecretKeys = LOG_SECRETS) -> Column:
    """Secret removal inside JSON texts that all have one schema; NULL fields are kept. Keys
    outside the schema are not: where there may be any, use ``redact_json``."""
    dtype = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    # bound to a variable: field by field, the optimizer would parse the text once per field
    clean = F.transform(F.array(F.from_json(text, dtype)), lambda v: redact_keys(v, dtype, keys))[0]
    return F.to_json(clean, {"ignoreNullFields": "false"})


def redact_frame(df: DataFrame, keys: SecretKeys = LOG_SECRETS) -> DataFrame:
    """Each row as one object: top-level columns with secret names are replaced too."""
    out = []
    for field in df.schema.fields:
        if keys.hit(field.name):
            col = F.lit(keys.replacement)
        else:
            col = redact_keys(F.col(f"`{field.name}`"), field.dataType, keys, 1)
        out.append(col.alias(field.name))
    return df.select(*out)
