"""The governed views that scopes describe, as catalog rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.lookups import first_match, splittable, table_lookup
from palisade.plans.governed_sql import GovernedSession
from palisade.sources.policy import FILTERS, Bundle

# Fixed values, here and below: names, descriptions, parameters and statements of views.
ANY_TABLE = "*"


def _table_name() -> Column:
    return F.coalesce(F.nullif(F.col("table"), F.lit("")), F.lit(ANY_TABLE))


def view_name(source: Column, table: Column, agent: Column) -> Column:
    name = F.concat(F.lit("query_"), source, F.lit("_"), table, F.lit("_"), agent)
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"))


def statement(fields: Column, table: Column, filters: Column) -> Column:
    """SELECT text with one numbered parameter per filter key."""
    chosen = F.when(F.size(fields) > 0, F.array_join(fields, ", ")).otherwise(F.lit("*"))
    target = F.when(table == ANY_TABLE, F.lit("{{.table}}")).otherwise(table)
    tests = F.transform(filters, lambda f, i: F.concat(f["key"], F.lit(" = $"), (i + 1).cast("string")))
    where = F.when(filters.isNotNull(), F.concat(F.lit(" WHERE "), F.array_join(tests, " AND "))).otherwise(F.lit(""))
    return F.concat(F.lit("SELECT "), chosen, F.lit(" FROM "), target, where)


def is_database(kind: Column) -> Column:
    return kind != "rest"


def database_sources(bundle: Bundle) -> DataFrame:
    return bundle.sources.filter(is_database(F.col("type")))


def has_database_sources(bundle: Bundle) -> DataFrame:
    return database_sources(bundle).agg((F.count("*") > 0).alias("has_database_sources"))


def view_rows(bundle: Bundle) -> DataFrame:
    """One view per scope rule on a database source. Every scope counts, each with the first
    entry it has for the source; of equal names the first rule's view stays."""
    rules = bundle.scope_rules
    entry = rules.groupBy("scope_pos", "source").agg(F.min("source_pos").alias("source_pos"))
    rules = rules.join(splittable(entry, "source"), ["scope_pos", "source", "source_pos"], "left_semi")
    rules = rules.filter("rule_pos is not null")
    sources = database_sources(bundle).select(
        F.col("name").alias("source"), F.col("type").alias("source_type"), F.col("pos").alias("listed")
    )
    table, fields = _table_name(), F.col("fields")
    described = F.concat(
        F.lit("Query "), table, F.lit(" in "), F.col("source"), F.lit(" (agent: "), F.col("agent"), F.lit(")"),
        F.when(fields.isNotNull(), F.concat(F.lit(" — fields: "), F.array_join(fields, ", "))).otherwise(F.lit("")),
    )
    parameters = F.when(table == ANY_TABLE, F.array(F.lit("agent"), F.lit("table"))).otherwise(
        F.array(F.lit("agent"))
    )
    views = rules.join(bundle.hint(sources), "source").select(
        view_name(F.col("source"), table, F.col("agent")).alias("name"),
        F.concat("source_type", F.lit("-sql")).alias("type"),
        "source",
        table.alias("table"),
        "agent",
        described.alias("description"),
        parameters.alias("parameters"),
        statement(fields, table, F.col("filters").cast(FILTERS)).alias("statement"),
        "listed",
        "scope_pos",
        "rule_pos",
    )
    views = first_match(views, ["source", "name"], ["scope_pos", "rule_pos"])
    caps = table_lookup(bundle).filter("max_rows > 0").select("source", "table", "max_rows")
    return views.join(bundle.hint(caps), ["source", "table"], "left")


def view_groups(views: DataFrame) -> DataFrame:
    """Members of the group ``<source>_tools`` of each source, one row per view; scope_pos
    and rule_pos give the list order. A source's views are never gathered in one place."""
    return views.select(
        F.concat("source", F.lit("_tools")).alias("name"), F.col("name").alias("view"), "scope_pos", "rule_pos"
    )


def group_lists(groups: DataFrame) -> DataFrame:
    """(name, views): each group as one list, for readers that show it whole. A list holds
    the views of one source, so large catalogs are better read as rows (``view_groups``)."""
    ordered = F.sort_array(F.collect_list(F.struct("scope_pos", "rule_pos", "view")))
    return groups.groupBy("name").agg(F.transform(ordered, lambda v: v["view"]).alias("views"))


def source_views(bundle: Bundle, prefix: str = "query__") -> DataFrame:
    """One entry per source, with its type and a help text."""
    return bundle.sources.select(
        F.concat(F.lit(prefix), "name").alias("name"),
        "type",
        F.concat(
            F.lit('Query the "'), "name", F.lit('" '), "type",
            F.lit(" data source. Credentials stay with the reader; access is scoped and audited."),
        ).alias("description"),
    )


def register_views(session: GovernedSession, tables: Iterable[str]) -> dict[str, list[str]]:
    """Make governed temp views of the tables an agent asks for; returns their masked columns."""
    session.register(*tables)
    return session.masked_columns()
