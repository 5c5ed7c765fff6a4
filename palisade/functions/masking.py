"""Column masks. Every mask is a built-in expression, keeps NULL as NULL and yields a string."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the mask formats.
STRATEGIES = ("none", "hash", "redact", "tokenize", "partial")
REDACTED = "***REDACTED***"
HASH_PREFIX = "sha256:"
TOKEN_PREFIX = "tok_"
TOKEN_DIGITS = 12
HIDDEN = "****"
VISIBLE_TAIL = 4

_WORD = 0xFFFFFFFF


def as_text(value: Column, dtype: T.DataType, compat: bool = False) -> Column:
    """The text a mask works on.

    Numbers print as Spark prints them (``1.0``, ``1.0E21``). In ``compat`` mode whole
    doubles below 2**53 print without a fraction (``1``), as a JavaScript number would;
    other doubles keep Spark's text.
    """
    text = value.cast("string")
    if compat and isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(float(2**53)))
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(text)
    return text


def rolling_digest(text: Column) -> Column:
    """32-bit rolling hash over UTF-16 units (h*31 + unit), absolute value in lower-case hex.

    Splits into code points and feeds the two surrogates of an astral one separately. One
    pass over the text, but interpreted: prefer the SHA-256 masks for long texts.
    """

    def push(h: Column, unit: Column) -> Column:
        return (h * F.lit(31).cast("bigint") + unit).bitwiseAND(F.lit(_WORD))

    def step(h: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        high = F.shiftright(point, 10) + F.lit(0xD7C0)
        low = point.bitwiseAND(F.lit(0x3FF)) + F.lit(0xDC00)
        return F.when(point < 0x10000, push(h, point)).otherwise(push(push(h, high), low))

    h = F.aggregate(F.split(text, F.lit("")), F.lit(0).cast("bigint"), step)
    return F.lower(F.hex(F.when(h >= 2**31, F.lit(2**32) - h).otherwise(h)))


def digest(text: Column, salt: str = "", compat: bool = False) -> Column:
    if compat:
        return rolling_digest(text)
    return F.sha2(F.concat(F.lit(salt), text) if salt else text, 256)


def token(text: Column, salt: str = "", compat: bool = False, whole: bool = False) -> Column:
    """The short token for display, or one of the ``whole`` digest, which a vault can turn back
    without doubt: 12 digits begin to collide near 16 million values, the compat hash long before."""
    found = digest(text, salt, compat)
    return F.concat(F.lit(TOKEN_PREFIX), found if whole else F.substring(found, 1, TOKEN_DIGITS))


def partial(text: Column, fmt: str | None = None) -> Column:
    """Show the last characters only.

    Without a format the last four stay, and short texts vanish whole. In a format the
    final run of ``*`` shows as many last characters (padded with ``*``); all else in it
    is literal. Lengths count code points, so a character is never cut in half.
    """
    if not fmt:
        tail = F.concat(F.lit(HIDDEN), F.right(text, F.lit(VISIBLE_TAIL)))
        return F.when(F.length(text) <= VISIBLE_TAIL, F.lit(HIDDEN)).otherwise(tail)
    literal = fmt.rstrip("*")
    shown = len(fmt) - len(literal)
    if shown == 0:
        return F.when(text.isNotNull(), F.lit(fmt))
    return F.concat(F.lit(literal), F.rpad(F.right(text, F.lit(shown)), shown, "*"))


def mask(
    value: Column,
    strategy: str,
    fmt: str | None = None,
    *,
    dtype: T.DataType = T.StringType(),
    salt: str = "",
    compat: bool = False,
    hide_nulls: bool = False,
    whole_tokens: bool = False,
) -> Column:
    """One mask by name. ``hide_nulls`` turns redact into a plain literal, so that the raw
    column is not even read from storage; ``whole_tokens`` are tokens for a vault."""
    if strategy == "none":
        return value
    if strategy == "redact":
        return F.lit(REDACTED) if hide_nulls else F.when(value.isNotNull(), F.lit(REDACTED))
    text = as_text(value, dtype, compat)
    if strategy == "hash":
        return F.concat(F.lit(HASH_PREFIX), digest(text, salt, compat))
    if strategy == "tokenize":
        return token(text, salt, compat, whole_tokens)
    if strategy == "partial":
        return partial(text, fmt)
    raise ValueError(f"unknown masking strategy: {strategy}")


def masked_names(columns: Iterable[str], policies: Iterable[Mapping]) -> list[dict]:
    """Policies that bite on the given columns: names compare without regard to case."""
    present = {c.lower(): c for c in columns}
    return [
        {"name": present[p["name"].lower()], "strategy": p["masking"], "format": p.get("mask_format")}
        for p in policies
        if p["masking"] != "none" and p["name"].lower() in present
    ]


def mask_frame(
    df: DataFrame, policies: Iterable[Mapping], *, salt: str = "", compat: bool = False, hide_nulls: bool = False
) -> DataFrame:
    """Mask all policy columns the frame has, in one projection; other columns pass through."""
    hits = masked_names(df.columns, policies)
    if not hits:
        return df
    out = []
    for field in df.schema.fields:
        col, dtype = F.col(f"`{field.name}`"), field.dataType
        for hit in hits:
            if hit["name"] == field.name:
                col = mask(
                    col, hit["strategy"], hit["format"], dtype=dtype, salt=salt, compat=compat, hide_nulls=hide_nulls
                )
                dtype = T.StringType()
        out.append(col.alias(field.name))
    return df.select(*out)
