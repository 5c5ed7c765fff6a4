"""Masks, token vault, nested redaction."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from checks.relations import CONFIG, registered, table
from palisade.functions import masking, redaction
from palisade.operators import vault

_HASH32 = """(SELECT format('{{:x}}', CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) FROM (SELECT
 list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c:
 CASE WHEN c < 65536 THEN (h * 31 + c) % 4294967296 ELSE
 (((h * 31 + 55232 + (c >> 10)) % 4294967296) * 31 + 56320 + (c & 1023)) % 4294967296 END, 0::BIGINT) AS h))"""


def hash32_sql(expr: str) -> str:
    return f"CASE WHEN {expr} = '' THEN '0' ELSE {_HASH32.format(expr)} END"


@registered("SELECT c_custkey, c_name AS masked FROM customer")
def mask_none(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", masking.mask(F.col("c_name"), "none").alias("masked"))


@registered(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN '***REDACTED***' END AS masked FROM lineitem"
)
def mask_redact(spark, sf_dir):
    value = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))  # some NULLs stay NULL
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", masking.mask(value, "redact").alias("masked")
    )


@registered("SELECT doc_id, 'sha256:' || sha256(text) AS masked FROM documents")
def mask_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask(F.col("text"), "hash").alias("masked"))


@registered("SELECT o_orderkey, 'sha256:' || sha256('pepper' || CAST(o_custkey AS VARCHAR)) AS masked FROM orders")
def mask_hash_salted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    masked = masking.mask(F.col("o_custkey"), "hash", dtype=orders.schema["o_custkey"].dataType, salt="pepper")
    return orders.select("o_orderkey", masked.alias("masked"))


@registered(f"SELECT conv_id, turn, 'sha256:' || {hash32_sql('text')} AS masked FROM conversations")
def mask_hash_compat(spark, sf_dir):
    masked = masking.mask(F.col("text"), "hash", compat=True)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", masked.alias("masked"))


@registered("SELECT c_custkey, 'tok_' || left(sha256(c_name), 12) AS masked FROM customer")
def mask_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", masking.mask(F.col("c_name"), "tokenize").alias("masked")
    )


@registered(
    f"""SELECT l_orderkey, l_linenumber, 'tok_' || {hash32_sql("CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")} AS masked
FROM lineitem"""
)
def mask_tokenize_compat(spark, sf_dir):
    """Whole doubles print without a fraction before they are hashed."""
    lines = table(spark, sf_dir, "lineitem")
    masked = masking.mask(F.col("l_quantity"), "tokenize", dtype=lines.schema["l_quantity"].dataType, compat=True)
    return lines.select("l_orderkey", "l_linenumber", masked.alias("masked"))


@registered("SELECT doc_id, CASE WHEN length(text) <= 4 THEN '****' ELSE '****' || right(text, 4) END AS masked FROM documents")
def mask_partial(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask(F.col("text"), "partial").alias("masked"))


@registered(
    """SELECT c_custkey, 'name-' || right(c_name, 4) AS tail_form, '***@****.' || rpad(right(c_mktsegment, 3), 3, '*')
AS mail_form, 'cust #' || rpad(right(CAST(c_nationkey AS VARCHAR), 4), 4, '*') AS padded, '**x**y' AS no_tail FROM customer"""
)
def mask_partial_format(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        masking.mask(F.col("c_name"), "partial", "name-****").alias("tail_form"),
        masking.mask(F.col("c_mktsegment"), "partial", "***@****.***").alias("mail_form"),
        masking.mask(F.col("c_nationkey"), "partial", "cust #****").alias("padded"),
        masking.mask(F.col("c_name"), "partial", "**x**y").alias("no_tail"),
    )


@registered(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'sha256:' || sha256(o_orderpriority) END AS h,
CASE WHEN o_orderstatus <> 'F' THEN 'tok_' || left(sha256(o_orderpriority), 12) END AS t,
CASE WHEN o_orderstatus <> 'F' THEN '****' || right(o_orderpriority, 4) END AS p,
CASE WHEN o_orderstatus <> 'F' THEN 'a-' || right(o_orderpriority, 1) END AS f,
CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS n FROM orders"""
)
def mask_keeps_nulls(spark, sf_dir):
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        masking.mask(value, "hash").alias("h"),
        masking.mask(value, "tokenize").alias("t"),
        masking.mask(value, "partial").alias("p"),
        masking.mask(value, "partial", "a-*").alias("f"),
        masking.mask(value, "none").alias("n"),
    )


_TABLE_MASKS = [
    {"name": "L_COMMENT", "masking": "redact"},  # not in the data: skipped
    {"name": "L_SHIPDATE", "masking": "redact"},
    {"name": "l_extendedprice", "masking": "partial"},
    {"name": "l_suppkey", "masking": "tokenize"},
    {"name": "l_tax", "masking": "none"},
]


@registered(
    """SELECT l_orderkey, l_partkey, 'tok_' || left(sha256(CAST(l_suppkey AS VARCHAR)), 12) AS l_suppkey, l_linenumber,
l_quantity, CASE WHEN length(CAST(l_extendedprice AS VARCHAR)) <= 4 THEN '****' ELSE
'****' || right(CAST(l_extendedprice AS VARCHAR), 4) END AS l_extendedprice, l_discount, l_tax, l_returnflag,
l_linestatus, '***REDACTED***' AS l_shipdate FROM lineitem"""
)
def mask_table(spark, sf_dir):
    """All masks of a table in one projection."""
    return masking.mask_frame(table(spark, sf_dir, "lineitem"), _TABLE_MASKS)


@registered(
    """SELECT p."table", m.name, m.strategy, count(*) AS rows_masked FROM (SELECT 'customer' AS "table" FROM customer) p
JOIN (VALUES ('c_name', 'partial'), ('c_acctbal', 'redact')) m(name, strategy) ON true GROUP BY ALL"""
)
def masked_columns_report(spark, sf_dir):
    """Columns really masked, with the number of values each mask hides."""
    customer = table(spark, sf_dir, "customer")
    policies = [
        {"name": c["name"], "masking": c["masking"], "mask_format": c.get("maskFormat")}
        for c in CONFIG["governance"]["sourcePolicies"][0]["tables"][0]["columns"]
    ]
    hits = masking.masked_names(customer.columns, policies)
    counts = customer.select(
        F.lit("customer").alias("table"), *[F.count(h["name"]).alias(f"n{i}") for i, h in enumerate(hits)]
    )
    entries = [
        F.struct(F.lit(h["name"]).alias("name"), F.lit(h["strategy"]).alias("strategy"), F.col(f"n{i}").alias("rows"))
        for i, h in enumerate(hits)
    ]
    return counts.select("table", F.explode(F.array(*entries)).alias("m")).select(
        "table", "m.name", "m.strategy", F.col("m.rows").alias("rows_masked")
    )


_VAULT_SQL = """SELECT 'c_name' AS "column", 'tok_' || left(sha256(v), 12) AS token, v AS value
FROM (SELECT DISTINCT c_name AS v FROM customer) UNION ALL
SELECT 'c_mktsegment', 'tok_' || left(sha256(v), 12), v FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)"""


@registered(_VAULT_SQL)
def token_vault(spark, sf_dir):
    return vault.token_vault(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@registered("SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def detokenize(spark, sf_dir):
    """Tokenize two columns, then give one its values back through the vault."""
    orders = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in orders.schema}
    book = vault.token_vault(orders, ["o_orderpriority", "o_custkey"])
    hidden = orders.select(
        "o_orderkey",
        *[masking.mask(F.col(c), "tokenize", dtype=kinds[c]).alias(c) for c in ("o_orderpriority", "o_custkey")],
    )
    return vault.detokenize(vault.detokenize(hidden, "o_orderpriority", book), "o_custkey", book)


@registered("SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def detokenize_bucketed(spark, sf_dir):
    """The same through a vault that is stored once, bucketed by token."""
    orders = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in orders.schema}
    book = vault.store_vault(vault.token_vault(orders, ["o_orderpriority", "o_custkey"]))
    hidden = orders.select(
        "o_orderkey",
        *[masking.mask(F.col(c), "tokenize", dtype=kinds[c]).alias(c) for c in ("o_orderpriority", "o_custkey")],
    )
    for column in ("o_orderpriority", "o_custkey"):
        hidden = vault.detokenize(hidden, column, book, stored=True)
    return hidden


@registered(
    f"""SELECT 'n' AS "column", 'tok_' || {hash32_sql("c_name || 'Aa'")} AS token, count(*) * 2 AS values
FROM (SELECT c_name FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL"""
)
def token_collisions(spark, sf_dir):
    """Short digests do collide: tokens of the 32-bit hash that stand for several values."""
    return vault.token_collisions(vault.token_vault(_twins(spark, sf_dir), ["n"], compat=True))


# two endings to which the 32-bit hash is blind: 65 * 31 + 97 = 66 * 31 + 66
_TWINS_SQL = "SELECT c_custkey AS k, c_name || CASE WHEN c_custkey % 3 = 0 THEN 'BB' ELSE 'Aa' END AS n FROM customer UNION ALL SELECT -c_custkey, c_name || 'Aa' FROM customer"


def _twins(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    ending = F.when(F.col("c_custkey") % 3 == 0, "BB").otherwise("Aa")
    plain = customer.select((-F.col("c_custkey")).alias("k"), F.concat("c_name", F.lit("Aa")).alias("n"))
    return customer.select(F.col("c_custkey").alias("k"), F.concat("c_name", ending).alias("n")).unionByName(plain)


@registered(
    """SELECT k, CASE WHEN abs(k) % 3 <> 0 THEN n END AS n, abs(k) % 3 = 0 AS ambiguous, n AS whole FROM ("""
    + _TWINS_SQL + ")"
)
def detokenize_collisions(spark, sf_dir):
    """Colliding short tokens give no value and say so; whole ones give all values back. The
    number of rows stays."""
    rows = _twins(spark, sf_dir)
    short, long = vault.token_vault(rows, ["n"], compat=True), vault.token_vault(rows, ["n"], whole=True)
    hidden = rows.select("k", masking.mask(F.col("n"), "tokenize", compat=True).alias("n"),
        masking.mask(F.col("n"), "tokenize", whole_tokens=True).alias("whole"))
    back = vault.detokenize(hidden, "n", short, ambiguous="ambiguous")
    return vault.detokenize(back, "whole", long.withColumn("column", F.lit("whole")))


@registered(
    """SELECT event_id, '{"token":"[REDACTED]","data":{"k":' || regexp_extract(props, '[0-9]+') ||
',"Password":"[REDACTED]"},"list":[{"api_key":"[REDACTED]","n":' || user_id || '}]}' AS props FROM events"""
)
def redact_json_keys(spark, sf_dir):
    """Secrets anywhere in a JSON text, NULL ones included."""
    events = table(spark, sf_dir, "events")
    wrapped = F.concat(
        F.lit('{"token": null, "data": '), F.expr("substring(props, 1, length(props) - 1)"),
        F.lit(', "Password": "'), F.col("event_type"), F.lit('"}, "list": [{"api_key": 5, "n": '),
        F.col("user_id").cast("string"), F.lit("}]}"),
    )
    schema = "token string, data struct<k:bigint,Password:string>, list array<struct<api_key:bigint,n:bigint>>"
    dtype = T.StructType.fromDDL(schema)
    return events.select("event_id", redaction.redact_typed_json(wrapped, dtype).alias("props"))


@registered(
    """SELECT event_id, CASE event_id % 4
WHEN 0 THEN 'no json: {"token": ' || event_type
WHEN 1 THEN '{"id":' || event_id || ',"seen":[true,null,{"Token":"[REDACTED]","kind":"' || event_type || '"}],"secret":"[REDACTED]"}'
WHEN 2 THEN '[{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":{"k":{"api_key":"[REDACTED]","n":' || user_id || '}}}}}}}}}}}}]'
ELSE '{"k":' || regexp_extract(props, '[0-9]+') || '}' END AS props, event_id % 4 <> 0 AS parsed FROM events"""
)
def redact_any_json(spark, sf_dir):
    """Texts of no common shape: unknown keys stay, whole objects under secret keys go, secrets
    deeper than ten levels go too, and what is not JSON comes back flagged."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    event = F.col("event_id").cast("string")
    deep = "".join(f'{{"{c}":' for c in "abcdefghijk")
    texts = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('no json: {"token": '), kind))
        .when(F.col("event_id") % 4 == 1, F.concat(
            F.lit('{"id": '), event, F.lit(', "seen": [true, null, {"Token": {"x": [1, 2]}, "kind": "'), kind,
            F.lit('"}], "secret": ["a", {"b": 1}]}')))
        .when(F.col("event_id") % 4 == 2, F.concat(
            F.lit("[" + deep + '{"api_key": "s", "n": '), user, F.lit("}" + "}" * 11 + "]")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", redaction.redact_json(texts, compact=True).alias("r")).select(
        "event_id", F.col("r.text").alias("props"), F.col("r.parsed").alias("parsed")
    )


@registered(
    """SELECT event_id, CASE event_id % 5
WHEN 0 THEN '{ "n" : 1e400, "n" : ' || event_id || '.000000000000000000001 , "u":"\\ud800", "token" : "[REDACTED]" }'
WHEN 1 THEN '[-0.0, "token", {"pass":"' || event_type || '"} , {"api_key":"[REDACTED]" , "x-api-key" :"[REDACTED]"}]' || chr(10)
WHEN 2 THEN '{"token": NaN, "n": ' || user_id || '}'
WHEN 3 THEN '{"a": {"p\\u0061ssword": "[REDACTED]"}, "b": "\\"token\\": 1"}'
ELSE props END AS props, event_id % 5 <> 2 AS parsed FROM events"""
)
def redact_json_lossless(spark, sf_dir):
    """Only the values under secret keys change: numbers of any size, repeated keys, escapes and white space stay."""
    event, user, kind = (F.col(c).cast("string") for c in ("event_id", "user_id", "event_type"))
    texts = (
        F.when(F.col("event_id") % 5 == 0, F.concat(
            F.lit('{ "n" : 1e400, "n" : '), event, F.lit('.000000000000000000001 , "u":"\\ud800", "token" : '), user, F.lit(" }")))
        .when(F.col("event_id") % 5 == 1, F.concat(
            F.lit('[-0.0, "token", {"pass":"'), kind, F.lit('"} , {"api_key":[{"token":[]}, "]"] , "x-api-key" :"a\\"b"}]\n')))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"token": NaN, "n": '), user, F.lit("}")))
        .when(F.col("event_id") % 5 == 3, F.concat(
            F.lit('{"a": {"p\\u0061ssword": {"q": "'), kind, F.lit('"}}, "b": "\\"token\\": 1"}')))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", redaction.redact_json(texts).alias("r")).select(
        "event_id", F.col("r.text").alias("props"), F.col("r.parsed").alias("parsed")
    )


@registered(
    """SELECT page_id, '[REDACTED]' AS auth, url AS host, CASE WHEN page_id % 2 = 0 THEN '[REDACTED]' END AS api,
'Bearer ' || page_id AS bearer FROM pages"""
)
def redact_headers(spark, sf_dir):
    """A header map: secret names in any case."""
    secret = F.concat(F.lit("Bearer "), F.col("page_id").cast("string"))
    headers = F.create_map(
        F.lit("Authorization"), secret, F.lit("Host"), F.col("url"),
        F.when(F.col("page_id") % 2 == 0, F.lit("X-API-Key")).otherwise(F.lit("X-Other")), secret,
        F.lit("Trace"), secret,
    )
    clean = table(spark, sf_dir, "pages").select("page_id", redaction.redact_headers(headers).alias("h"))
    return clean.select(
        "page_id",
        F.col("h")["Authorization"].alias("auth"),
        F.col("h")["Host"].alias("host"),
        F.col("h")["X-API-Key"].alias("api"),
        F.col("h")["Trace"].alias("bearer"),
    )


@registered(
    """SELECT s_suppkey, 'src-' || s_suppkey AS name, '***' AS password, s_name AS host, '***' AS api_key,
s_name AS lower_key FROM supplier"""
)
def sanitize_credentials(spark, sf_dir):
    """Source definitions for display: exact-case password and apiKey hidden at any depth."""
    from palisade.sources.registry import list_without_secrets

    definitions = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("src-"), F.col("s_suppkey").cast("string")).alias("name"),
        F.struct(
            F.struct(F.col("s_acctbal").alias("password"), F.col("s_name").alias("host")).alias("login"),
            F.array(F.struct(F.col("s_name").alias("apiKey"))).alias("keys"),
            F.struct(F.col("s_name").alias("apikey")).alias("other"),
        ).alias("credentials"),
    )
    clean = list_without_secrets(definitions)
    return clean.select(
        "s_suppkey",
        "name",
        F.col("credentials.login.password").alias("password"),
        F.col("credentials.login.host").alias("host"),
        F.col("credentials.keys")[0]["apiKey"].alias("api_key"),
        F.col("credentials.other.apikey").alias("lower_key"),
    )
