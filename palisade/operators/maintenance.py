"""Policy-table maintenance. Every change returns a new bundle; old ones stay valid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.classes import CLASSES
from palisade.functions.masking import STRATEGIES
from palisade.operators.lookups import splittable
from palisade.sources.config import OPERATIONS, SOURCE_TYPES, checked_scope, checked_source
from palisade.sources.policy import SCHEMAS, Bundle, fetch, local_frame, scope_rows, source_row


def upsert_scopes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the scopes of all agents named in ``changes``, in place; new agents go to the
    end. The last of several changes for one agent wins."""
    last = splittable(changes.groupBy("agent").agg(F.max("scope_pos").alias("scope_pos")), "agent")
    changes = changes.join(last, ["agent", "scope_pos"], "left_semi")
    end = rules.agg(F.coalesce(F.max("scope_pos"), F.lit(-1)))
    old = rules.join(last.select("agent"), "agent", "left_semi")
    old = splittable(old.groupBy("agent").agg(F.min("scope_pos").alias("_old")), "agent")
    placed = changes.join(old, "agent", "left")
    placed = placed.withColumn("scope_pos", F.coalesce("_old", end.scalar() + 1 + F.col("scope_pos"))).drop("_old")
    kept = rules.join(last.select("agent"), "agent", "left_anti")
    # a second, shadowed scope of a replaced agent stays behind its replacement
    shadowed = rules.join(old, "agent").filter("scope_pos > _old").drop("_old")
    return kept.unionByName(shadowed).unionByName(placed)


def set_scope(bundle: Bundle, raw: Mapping) -> Bundle:
    """Add or replace one agent's scope."""
    scope = checked_scope(raw)
    change = local_frame(bundle.scope_rules.sparkSession, scope_rows(0, scope), SCHEMAS["scope_rules"])
    return bundle.with_tables(scope_rules=upsert_scopes(bundle.scope_rules, change))


def remove_scopes(rules: DataFrame, agents: DataFrame) -> DataFrame:
    """Drop the first scope of each named agent; a second one then takes effect."""
    first = rules.join(splittable(agents.select("agent").distinct(), "agent"), "agent", "left_semi")
    first = splittable(first.groupBy("agent").agg(F.min("scope_pos").alias("scope_pos")), "agent")
    return rules.join(first, ["agent", "scope_pos"], "left_anti")


def remove_scope(bundle: Bundle, agent: str) -> tuple[Bundle, bool]:
    rules = bundle.scope_rules
    found = bool(fetch(rules.filter(F.col("agent") == agent).select("agent").limit(1)))
    named = rules.filter(F.col("agent") == agent).select("agent")
    return bundle.with_tables(scope_rules=remove_scopes(rules, named)), found


def add_sources(sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources after, rejected): a new source whose name is taken is rejected, as are later
    repeats among the new ones."""
    names = splittable(sources.select("name").distinct(), "name")
    taken = new.join(names, "name", "left_semi")
    free = new.join(names, "name", "left_anti")
    first = splittable(free.groupBy("name").agg(F.min("pos").alias("pos")), "name")
    accepted = free.join(first, ["name", "pos"], "left_semi")
    repeated = free.join(first, ["name", "pos"], "left_anti")
    return sources.unionByName(accepted), taken.unionByName(repeated)


def add_source(bundle: Bundle, raw: Mapping) -> Bundle:
    source = checked_source(raw)
    if fetch(bundle.sources.filter(F.col("name") == source["name"]).limit(1)):
        raise ValueError(f"Duplicate source name: {source['name']}")
    end = bundle.sources.agg(F.max("pos")).first()[0]
    row = source_row(0 if end is None else end + 1, source)
    new = local_frame(bundle.sources.sparkSession, [row], SCHEMAS["sources"])
    return bundle.with_tables(sources=bundle.sources.unionByName(new))


def remove_sources(sources: DataFrame, names: DataFrame) -> DataFrame:
    return sources.join(splittable(names.select("name").distinct(), "name"), "name", "left_anti")


def remove_source(bundle: Bundle, name: str) -> tuple[Bundle, bool]:
    found = bool(fetch(bundle.sources.filter(F.col("name") == name).limit(1)))
    return bundle.with_tables(sources=bundle.sources.filter(~F.col("name").eqNullSafe(F.lit(name)))), found


def _not_in(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def _bad_items(column: str, allowed: tuple[str, ...]) -> Column:
    return F.exists(F.col(column), lambda v: ~v.isin(*allowed))


def _violations(df: DataFrame, table: str, key: Column, tests: list[tuple[Column, str, str]]) -> DataFrame:
    """All tests in one scan: (table, key, path, message) for each one that fails."""
    found = F.array(
        *[
            F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(text).alias("message")))
            for test, path, text in tests
        ]
    )
    rows = df.select(
        F.lit(table).alias("policy_table"),
        key.alias("key"),
        F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v"),
    )
    return rows.select("policy_table", "key", "v.path", "v.message")


def policy_violations(bundle: Bundle) -> DataFrame:
    """Every broken rule of the policy tables: (policy_table, key, path, message)."""

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    def key(*parts: str) -> Column:
        return F.concat_ws(".", *[F.coalesce(F.col(p), F.lit("")) for p in parts])

    # Paths and messages, here and below.
    bad_class, negative = "Invalid classification", "Number must be greater than or equal to 0"
    reports = [
        _violations(
            bundle.sources,
            "sources",
            key("name"),
            [(blank("name"), "name", "Required"), (_not_in("type", SOURCE_TYPES), "type", "Invalid source type")],
        ),
        _violations(
            bundle.scope_rules,
            "scope_rules",
            key("agent", "source"),
            [
                (blank("agent"), "agent", "Agent ID must not be empty"),
                (blank("source"), "sources", "At least one source is required"),
            ],
        ),
        _violations(
            bundle.source_policy,
            "source_policy",
            key("source"),
            [
                (blank("source"), "source", "Required"),
                (_not_in("default_class", CLASSES), "defaultClassification", bad_class),
            ],
        ),
        _violations(
            bundle.table_policy,
            "table_policy",
            key("source", "table"),
            [
                (blank("table"), "table", "Required"),
                (_not_in("classification", CLASSES), "classification", bad_class),
                (F.col("max_rows") < 0, "maxRows", negative),
            ],
        ),
        _violations(
            bundle.column_policy,
            "column_policy",
            key("source", "table", "name"),
            [
                (blank("name"), "name", "Required"),
                (_not_in("classification", CLASSES), "classification", bad_class),
                (_not_in("masking", STRATEGIES), "masking", "Invalid masking strategy"),
            ],
        ),
        _violations(
            bundle.agent_policy,
            "agent_policy",
            key("agent"),
            [
                (blank("agent"), "agent", "Required"),
                (_bad_items("allowed_classes", CLASSES), "allowedClassifications", bad_class),
                (_bad_items("allowed_ops", OPERATIONS), "allowedOperations", "Invalid operation"),
                (F.col("max_rows") < 0, "maxRowsPerQuery", negative),
                (F.col("max_concurrency") < 1, "maxConcurrency", "Number must be greater than 0"),
                (F.col("timeout_ms") < 1, "queryTimeoutMs", "Number must be greater than 0"),
            ],
        ),
    ]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def tables_without_policy(catalog: DataFrame, bundle: Bundle) -> DataFrame:
    """Catalog tables (source, table) that fall back to their source's default."""
    return catalog.select("source", "table").subtract(bundle.table_policy.select("source", "table"))


def agents_without_scope(bundle: Bundle) -> DataFrame:
    """Agents with a policy that no scope lets in."""
    return bundle.agent_policy.select("agent").subtract(bundle.scope_rules.select("agent"))


def agents_without_policy(bundle: Bundle) -> DataFrame:
    """Agents with a scope that fall back to the default policy."""
    return bundle.scope_rules.select("agent").subtract(bundle.agent_policy.select("agent"))


def agents_covered(bundle: Bundle) -> DataFrame:
    return bundle.scope_rules.select("agent").intersect(bundle.agent_policy.select("agent"))
