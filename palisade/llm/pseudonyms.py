"""Format-preserving pseudonyms of personal numbers, dates and addresses, in SQL functions only.

What is found must be valid: card numbers by the Luhn sum, social security numbers by area, group and serial,
telephone numbers by the North American plan or as international numbers, bank accounts (IBAN) by their check
digits and the length of their country (``IBAN_LENGTHS``), IPv4 addresses by their range, dates by the calendar (1800-2199), e-mail addresses by their form.
A text with a match that is not valid is searched again for valid values alone, those inside or across that match included.
A keyed Feistel network permutes each kind within its own format: a card number keeps its length, first digit
and a right Luhn sum, a date is another date written alike, and so on. Equal values get equal pseudonyms
in all documents, also when they are grouped differently; different values get different ones.

Two networks serve all kinds, both bijective without any table. ``permute_text`` shifts every letter and
digit of one half of a string, within its own class, by a digest of the other half; ``permute_pair`` does the
same with two numbers modulo the sizes of their ranges.

NULL texts count as empty and stay empty strings; texts without a find come back as they are. Repeated rows
get equal results. An empty table gives an empty result. The key is a secret of the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_texts

ROUNDS = 8

# The characters of an IBAN of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form() -> str:
    """Countries of one length are one alternative; blanks may stand before each group of four."""
    each = []
    for length, names in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        each.append(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(each)})(?![A-Za-z0-9])"


# What each kind looks like. Order matters where two could start at the same place. No form captures.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": _iban_form(),
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?[0-9]){7,13}(?![0-9])",
    "ipv4": r"(?<![0-9])(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:1[89]|2[01])[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:1[89]|2[01])[0-9]{2})(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[47][0-9]{2}(?: [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5})|[0-9]{13,19})(?![0-9])",
}
#: Where a value may stand and end, for the kinds of which a form alone does not tell that a value is valid.
BOUNDS = {
    "iban": (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"),
    "ssn": (r"(?<![0-9-])", r"(?![0-9-])"),
    "date": (r"(?<![0-9./-])", r"(?![0-9]|[./-][0-9])"),
    "card": (r"(?<![0-9])", r"(?![0-9])"),
}
_NO_VALUE = "(?!)"


def _searched() -> dict[str, str]:
    """The forms as texts are searched for them: an international number that could end does not run on into another value."""
    others = "|".join(FORMS[kind] for kind in ("email", "phone", "ipv4", "ssn", "date", "card"))
    intl = rf"(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?[0-9]){{7}}(?:(?:[ .-](?!{others}))?[0-9]){{0,6}}(?![0-9])"
    return FORMS | {"intl": intl}


SEARCHED = _searched()
ANY = "|".join(f"(?:{form})" for form in SEARCHED.values())
#: Dates as days of one whole Gregorian cycle of 400 years: 27 * 5411 days from here.
FIRST_DAY, CYCLE = "1800-01-01", (27, 5411)


def _digest(key: str, kind: str, *parts: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key)), bits)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _shifted(text: Column, digest: Column) -> Column:
    """Every letter and digit moved within its class by a byte of the digest; other characters stay."""

    def one(c: Column, at: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def moved(alphabet: str) -> Column:
            return F.substr(F.lit(alphabet), (F.ascii(c) - ord(alphabet[0]) + by) % len(alphabet) + 1, F.lit(1))

        return (
            F.when(c.between("0", "9"), moved("0123456789"))
            .when(c.between("a", "z"), moved("abcdefghijklmnopqrstuvwxyz"))
            .when(c.between("A", "Z"), moved("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A permutation of the strings with the same class of character at each place."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        left = F.when(k % 2 == 1, _shifted(acc["l"], _digest(key, kind, k, acc["r"], bits=512))).otherwise(acc["l"])
        right = F.when(k % 2 == 0, _shifted(acc["r"], _digest(key, kind, k, acc["l"], bits=512))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_pair(x: Column, y: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of the pairs (x, y) with 0 <= x < sizes[0] and 0 <= y < sizes[1], as a struct of both."""

    def turn(acc: Column, k: Column) -> Column:
        one = F.when(k % 2 == 1, (acc["x"] + _number(_digest(key, kind, k, acc["y"], bits=256))) % sizes[0]).otherwise(acc["x"])
        two = F.when(k % 2 == 0, (acc["y"] + _number(_digest(key, kind, k, acc["x"], bits=256))) % sizes[1]).otherwise(acc["y"])
        return F.struct(one.alias("x"), two.alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column, what: str = "[0-9]") -> Column:
    """``form`` with its digits (or characters like ``what``) replaced, in order, by those of ``digits``."""

    def filled(d: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            before = at - F.length(F.regexp_replace(F.substr(form, F.lit(1), at), what, ""))
            return F.when(c.rlike(what), F.substr(d, before + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(form, ""), one), "")

    return _bound(digits, filled)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled`` is 1 if every second digit from the last but one is doubled, 0 if from the last."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, at: F.when(at % 2 == doubled, c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)).otherwise(c.try_cast("int")),
    )
    return F.aggregate(places, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    payload = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    new = _bound(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - _luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _refilled(m, new))


def _iban_rest(moved: Column) -> Column:
    """The number that the characters stand for, modulo 97."""
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc),
    )


def _iban_valid(plain: Column) -> Column:
    return _iban_rest(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))

    def checked(new: Column) -> Column:
        return F.concat(country, F.lpad((F.lit(98) - _iban_rest(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    return F.when(_iban_valid(plain), _refilled(m, _bound(permute_text(account, key, "iban"), checked), "[A-Z0-9]"))


def _phone(m: Column, key: str) -> Column:
    digits = F.substr(_digits(m), F.lit(-10), F.lit(10)).cast("long")
    place = digits - 2_000_000_000
    pair = permute_pair(F.floor(place / 10_000_000), _exchange(digits), (800, 8_000_000), key, "phone")
    new = _bound(pair, lambda p: F.lpad(((p["x"] + 200) * 10_000_000 + p["y"] + 2_000_000).cast("string"), 10, "0"))
    country = F.when(F.length(_digits(m)) == 11, "1").otherwise("")
    return _refilled(m, F.concat(country, new))


def _exchange(digits: Column) -> Column:
    return digits % 10_000_000 - 2_000_000


def _intl(m: Column, key: str) -> Column:
    digits = _digits(m)
    return _refilled(m, F.concat(F.substr(digits, F.lit(1), F.lit(2)), permute_text(F.substr(digits, F.lit(3)), key, "intl")))


def _ipv4(m: Column, key: str) -> Column:
    part = [F.split(m, r"\.")[k].cast("long") for k in range(4)]
    pair = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ipv4")
    return _bound(pair, lambda p: F.concat_ws(".", *[n.cast("string") for x in (p["x"], p["y"]) for n in (F.floor(x / 256), x % 256)]))


def _ssn_parts(m: Column) -> tuple[Column, ...]:
    return tuple(F.split(m, "-")[k].try_cast("int") for k in range(3))


def _ssn_valid(area: Column, group: Column, serial: Column) -> Column:
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(m)
    valid = _ssn_valid(area, group, serial)
    pair = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")

    def written(p: Column) -> Column:
        new_area = p["x"] + 1 + F.when(p["x"] >= 665, 1).otherwise(0)
        parts = ((new_area, 3), (F.floor(p["y"] / 9999) + 1, 2), (p["y"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, _bound(pair, written))


def _date(m: Column, key: str) -> Column:
    """Written year-month-day, day.month.year, or with slashes month first where that is a date, else day first."""

    def one(form: str) -> Column:
        day = F.try_to_date(m, form)
        at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = permute_pair(F.floor(at / CYCLE[1]), at % CYCLE[1], CYCLE, key, "date")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), _bound(pair, lambda p: p["x"] * CYCLE[1] + p["y"]).cast("int"))
        return F.when(day.isNotNull(), F.date_format(new, form))

    slashes = F.coalesce(one("MM/dd/yyyy"), one("dd/MM/yyyy"))
    return F.when(m.contains("-"), one("yyyy-MM-dd")).when(m.contains("/"), slashes).otherwise(one("dd.MM.yyyy"))


def _email(m: Column, key: str) -> Column:
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permute_text(local, key, "email"), F.lit("@"), host)


_MAKE = {"email": _email, "iban": _iban, "phone": _phone, "intl": _intl, "ipv4": _ipv4, "ssn": _ssn, "date": _date, "card": _card}


#: Whether a value of a form is valid, without its pseudonym.
_VALID = {
    "iban": lambda m: _iban_valid(F.replace(m, F.lit(" "), F.lit(""))),
    "ssn": lambda m: _ssn_valid(*_ssn_parts(m)),
    "date": lambda m: F.coalesce(*[F.try_to_date(m, form) for form in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")]).isNotNull(),
    "card": lambda m: _luhn_sum(_digits(m), 1) % 10 == 0,
}


def _is(kind: str, m: Column) -> Column:
    return m.rlike(f"^(?:{FORMS[kind]})$")


def _invalid(m: Column) -> Column:
    """The match has the form of a kind, but is not valid."""
    out = F.lit(False)
    for kind in reversed(FORMS):
        out = F.when(_is(kind, m), ~_VALID[kind](m) if kind in _VALID else F.lit(False)).otherwise(out)
    return out


def _valid_only(text: Column) -> Column:
    """A pattern like ANY that finds, of the kinds that need a test, the valid values of this text only.

    Candidates are taken at every place, also inside others, so that no invalid one hides a valid one.
    """
    each = []
    for kind, form in SEARCHED.items():
        if kind not in _VALID:
            each.append(F.lit(f"(?:{form})"))
            continue
        values = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"(?=({form}))"), F.lit(1)), _VALID[kind]))
        literal = F.replace(F.array_join(values, "|"), F.lit("."), F.lit("\\."))
        before, after = BOUNDS[kind]
        each.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{before}(?:"), literal, F.lit(f"){after}"))).otherwise(_NO_VALUE))
    return F.concat_ws("|", *each)


def _found(m: Column, key: str) -> Column:
    """kind (NULL if not valid) and pseudonym of one match."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind in reversed(FORMS):
        named = F.lit(kind)
        one = _bound(_MAKE[kind](m, key), lambda v, named=named: F.struct(F.when(v.isNotNull(), named).alias("kind"), F.coalesce(v, m).alias("new")))
        out = F.when(_is(kind, m), one).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and kinds (array: the kind of each value replaced, in order) of every whole text."""
    texts = whole_texts(docs)
    maybe = F.col("text").rlike("[0-9]|@")
    none = F.array().cast("array<string>")
    first = texts.select("doc_id", "text", F.when(maybe, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none).alias("first"))
    again = first.select("*", F.when(F.exists("first", _invalid), _valid_only(F.col("text"))).alias("pattern"))
    cut = again.select(
        "doc_id",
        F.when(F.col("pattern").isNotNull(), F.split("text", F.col("pattern"), -1)).when(maybe, F.split("text", ANY, -1)).otherwise(F.array("text")).alias("between"),
        F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("first")).alias("matches"),
    )
    found = cut.select("doc_id", "between", F.transform("matches", lambda m: _found(m, key)).alias("found"))
    pieces = F.zip_with("between", "found", lambda a, f: F.concat(a, F.coalesce(f["new"], F.lit(""))))
    kinds = F.filter(F.transform("found", lambda f: f["kind"]), lambda k: k.isNotNull())
    return found.select("doc_id", F.array_join(pieces, "").alias("text"), kinds.alias("kinds"))
