"""The registered queries of this package, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact, fingerprints, language, licenses, lines, mixing, pseudonyms, repeats, secret_spans, simhash, variants, whitening
from .common import documents
from .license_texts import KNOWN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@registered()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = language.train(docs.where(language.learnable()).select("doc_id", "lang", "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return language.predict(docs, trees, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))


def coded(docs: DataFrame) -> DataFrame:
    """Digests of the ids that texts encode to, and of the bytes that the ids decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    there_and_back = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return there_and_back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@registered()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir))


@registered(
    """
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
        FROM documents),
    g AS (
        SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
        FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir)).drop("text_key")


@registered()
def op8_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("text_key", "root")


#: The mixture of op1 and of the pipeline: weights by name of a domain or language; sources weigh 1 each.
WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "en": 5, "de": 2, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = Fraction(1, 2), 2, 17


def domain():
    """The tables name no domains: the number that ends a source's name, modulo 4, stands for one."""
    return F.expr("concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int) % 4, 0))")


def _level_sql(level: int) -> str:
    names = list(mixing.LEVELS[: level + 1])
    name, parents = names[-1], ", ".join(names[:-1]) or "1"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    given = "JOIN l{0} USING ({1})".format(level - 1, parents) if level else "CROSS JOIN goal"
    budget = f"l{level - 1}.budget" if level else "goal.given"
    ordered = f"PARTITION BY {parents} ORDER BY cap / w::DOUBLE, {', '.join(names)} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
    n{level} AS (
        SELECT c.*, {budget} AS given FROM (
            SELECT {', '.join(names)}, sum(cap) AS cap, any_value(CASE {name} {cases} ELSE 1 END) AS w
            FROM leaf GROUP BY {', '.join(names)}) c {given}),
    o{level} AS (
        SELECT *, coalesce(sum(cap) OVER ({ordered} 1 PRECEDING), 0) AS cap_before,
               sum(w) OVER (PARTITION BY {parents}) - coalesce(sum(w) OVER ({ordered} 1 PRECEDING), 0) AS w_left
        FROM n{level}),
    f{level} AS (SELECT *, cap * w_left <= (given - cap_before) * w AS saturated FROM o{level}),
    r{level} AS (
        SELECT *, given - coalesce(sum(CASE WHEN saturated THEN cap END) OVER (PARTITION BY {parents}), 0) AS rest,
               sum(CASE WHEN NOT saturated THEN w END) OVER (PARTITION BY {parents}) AS w_rest,
               sum(CASE WHEN saturated THEN 0 ELSE w END) OVER ({ordered} CURRENT ROW) AS w_upto
        FROM f{level}),
    l{level} AS (
        SELECT {', '.join(names)},
               CASE WHEN saturated THEN cap ELSE rest * w_upto // w_rest - rest * (w_upto - w) // w_rest END AS budget
        FROM r{level})"""


@registered(
    f"""
    WITH m AS (
        SELECT doc_id, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4, 0) AS domain,
               coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
        FROM documents),
    leaf AS (
        SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {EPOCHS} AS cap
        FROM m GROUP BY domain, lang, source),
    goal AS (
        SELECT least(sum(tokens)::HUGEINT * {SHARE.numerator} // {SHARE.denominator}, sum(cap)::HUGEINT) AS given FROM leaf),
    {", ".join(_level_sql(k) for k in range(3))},
    plan AS (
        SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
               budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
        FROM l2 JOIN leaf USING (domain, lang, source)),
    run AS (
        SELECT m.*, whole, rest, sum(n_tokens) OVER (
            PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), n_tokens
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM m JOIN plan USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM run
    """
)
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), domain(), WEIGHTS, SHARE, EPOCHS, SEED).drop("text_key")


@registered()
def op2_locally_consistent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(documents(spark, sf_dir))


@registered()
def op3_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "field")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secret_spans.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: Only a key kept secret makes pseudonyms of it; this one serves the registered query and its tests.
PSEUDONYM_KEY = "not-a-secret"


@registered()
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymised(documents(spark, sf_dir), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g'), {_quoted(licenses.RESERVED)}, '', 'g')"
    out = f"regexp_replace({out}, {_quoted(licenses.NO_WORD)}, ' ', 'g')"
    for one, other in licenses.SPELLINGS.items():
        out = f"replace({out}, '{one}', '{other}')"
    return f"trim({out}, ' ')"


@registered(
    f"""
    WITH known AS (
        SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id
        FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN.items())}) v(license_id, text)
        GROUP BY 1),
    whole AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS form FROM documents),
    lines AS (SELECT doc_id, {_canonical_sql('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
    hits AS (
        SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names
        FROM lines JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id)
    SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, license_id, coalesce(n, 0) AS n_lines,
           coalesce(names, '') AS line_licenses
    FROM whole LEFT JOIN known ON sha256(form) = known.digest LEFT JOIN hits USING (doc_id)
    """
)
def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), KNOWN).drop("text_key")


@registered()
def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(documents(spark, sf_dir))


@registered(
    f"""
    WITH lines AS (
        SELECT doc_id, pos, lines[pos] AS line FROM (
            SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
    keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    often AS (
        SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {lines.MIN_POINTS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
    judged AS (SELECT k.*, o.key IS NOT NULL AND doc_id <> last AS gone FROM keyed k LEFT JOIN often o USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@registered()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@registered()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))
