"""Agent scopes: which tables, columns and rows an agent may ask for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.lookups import folded, splittable
from palisade.operators.single import active_rule_rows, merge_rule_rows
from palisade.session import materialise
from palisade.sources.policy import FILTERS, TEXT, TEXTS, Bundle, local_frame, struct


def active_rules(bundle: Bundle) -> DataFrame:
    """Rules of each agent's first scope and, in it, of the first entry of each source."""
    return bundle.scope_rules.join(
        splittable(active_entries(bundle), "agent"), ["agent", "scope_pos", "source", "source_pos"], "left_semi"
    )


def active_entries(bundle: Bundle) -> DataFrame:
    """(agent, scope_pos, source, source_pos) of the entries in force. The rules are folded to
    their entries once; an entry counts if its scope is the first one its agent has."""
    if "entries" in bundle.resolved:
        return bundle.resolved["entries"]
    place = F.min(F.struct("scope_pos", "source_pos")).alias("first")
    entries = bundle.scope_rules.groupBy("agent", "source").agg(place)
    entries = entries.select("agent", "source", "first.scope_pos", "first.source_pos")
    scopes = splittable(entries.groupBy("agent").agg(F.min("scope_pos").alias("scope_pos")), "agent")
    return entries.join(scopes, ["agent", "scope_pos"], "left_semi")


def rule_items(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, name, first, last): every field and filter key of a group of rules, once.

    Each item remembers where it came first (its place in the output) and what was said last
    (whose value wins). A group without any item keeps one row without kind.
    """
    gap = F.lit(None).cast("string")
    fields = F.transform(
        F.coalesce("fields", F.array().cast("array<string>")),
        lambda f, i: F.struct(
            F.lit("field").alias("kind"), f.alias("name"), gap.alias("value"), gap.alias("type"), i.alias("idx")
        ),
    )
    filters = F.transform(
        F.coalesce("filters", F.array().cast(FILTERS)),
        lambda f, i: F.struct(
            F.lit("filter").alias("kind"),
            f["key"].alias("name"),
            f["value"].alias("value"),
            f["type"].alias("type"),
            i.alias("idx"),
        ),
    )
    exploded = rules.select(*keys, "rule_pos", F.explode_outer(F.concat(fields, filters)).alias("item"))
    at = F.struct(F.col("rule_pos").alias("pos"), F.col("item.idx").alias("idx"))
    said = F.struct(at.alias("at"), F.col("item.value").alias("value"), F.col("item.type").alias("type"))
    items = exploded.select(*keys, "item.kind", "item.name", at.alias("first"), said.alias("last"))
    return _once(items, keys)


def _once(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeats collapse in the map tasks, before anything is gathered."""
    return items.groupBy(*keys, "kind", "name").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def gathered(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fields, filters) of distinct items: fields and filter keys in first-mention order, NULL
    (meaning all, and none) where there are none. A list is as long as the columns it names."""
    item = F.when(F.col("kind").isNotNull(), F.struct("first", "kind", "name", "last"))
    lists = items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    named = lists.select(
        *keys,
        F.filter("items", lambda i: i["kind"] == "field").alias("fields"),
        F.filter("items", lambda i: i["kind"] == "filter").alias("filters"),
    )
    test = lambda i: F.struct(i["name"].alias("key"), i["last"]["value"].alias("value"), i["last"]["type"].alias("type"))
    return named.select(
        *keys,
        F.when(F.size("fields") > 0, F.transform("fields", lambda i: i["name"])).alias("fields"),
        F.when(F.size("filters") > 0, F.transform("filters", test)).alias("filters"),
    )


SCOPE_TABLE = struct(agent=TEXT, source=TEXT, table=TEXT, fields=TEXTS, filters=FILTERS)


def merge_rules(bundle: Bundle) -> DataFrame:
    """One row per (agent, source, table) named by a rule, plus one with an empty table per
    source open through a rule without a table: the merged fields and filters. A named
    table also takes up what the rules without a table say."""
    if "merged" in bundle.resolved:
        return bundle.resolved["merged"]
    if bundle.small:
        return local_frame(bundle.spark, merge_rule_rows(bundle.rows["scope_rules"]), SCOPE_TABLE)
    keys = ["agent", "source", "table"]
    rules = active_rules(bundle).filter("rule_pos is not null")
    items = materialise(rule_items(rules, keys), "items")  # read three times below
    named = items.filter("table is not null").select(*keys).distinct()
    wide = items.filter("table is null").drop("table")
    copied = named.join(wide, ["agent", "source"]).select(items.columns)
    # both steps group by the keys, so one shuffle serves them; the items of a key are distinct by now, but for copies
    return gathered(_once(items.unionByName(copied).repartition(*keys), keys), keys)


ANSWER = struct(fields=TEXTS, filters=FILTERS)


def _scope_lookups(bundle: Bundle) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three lookups with one row per key: (agent), (agent, source, _wide) and (agent, source,
    table, _named). Sources listed without any rule are in the second one as well."""
    if bundle.small:
        active = active_rule_rows(bundle.rows["scope_rules"])
        merged = merge_rule_rows(active)
        wide = {(m["agent"], m["source"]): m for m in merged if m["table"] is None}
        pairs = dict.fromkeys((r["agent"], r["source"]) for r in active)
        agents = [{"agent": a} for a in dict.fromkeys(a for a, _ in pairs)]
        entries = [{"agent": a, "source": s, "_wide": wide.get((a, s))} for a, s in pairs]
        named = [{**m, "_named": m} for m in merged if m["table"] is not None]
        return (
            local_frame(bundle.spark, agents, struct(agent=TEXT)),
            local_frame(bundle.spark, entries, struct(agent=TEXT, source=TEXT, _wide=ANSWER)),
            local_frame(bundle.spark, named, struct(agent=TEXT, source=TEXT, table=TEXT, _named=ANSWER)),
        )
    answer, merged = F.struct("fields", "filters"), merge_rules(bundle)
    named = merged.filter("table is not null").select("agent", "source", "table", answer.alias("_named"))
    wide = merged.filter("table is null").select("agent", "source", answer.alias("_wide"))
    entries = active_entries(bundle).select("agent", "source")
    agents = splittable(entries.select("agent").distinct(), "agent")
    entries = splittable(entries.join(wide, ["agent", "source"], "left"), "agent")
    return agents, entries, splittable(named, "agent")


def resolve_scopes(bundle: Bundle) -> Bundle:
    """Work out the entries in force, and from them the merged rules, once, as tables in the shared folder, for callers
    that ask again and again."""
    if bundle.small or "merged" in bundle.resolved:
        return bundle
    kept = dict(bundle.resolved)
    bundle = replace(bundle, resolved=kept)
    kept["entries"] = materialise(active_entries(bundle), "entries")
    kept["merged"] = materialise(merge_rules(bundle), "merged")
    return bundle


def scope_decision(requests: DataFrame, bundle: Bundle, name: str = "scope") -> DataFrame:
    """Add struct<permitted, reason, fields, filters> for each (agent, source, table).

    Equi joins only, each side with one row per key: rules are merged first and those
    without a table join by (agent, source), so a request never multiplies.
    """
    if not bundle.small and not requests.isStreaming:
        bundle = resolve_scopes(bundle)  # three lookups read it
        # the texts of the reasons are made where the answers meet the requests, so that they need not move
        found = folded(requests, ["agent", "source", "table"], lambda asked: _found(asked, bundle))
    else:
        found = _found(requests, bundle)
    return found.select(*requests.columns, _told().alias(name))


def _found(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """Add what the lookups hold for each request."""
    agents, entries, named = _scope_lookups(bundle)
    joined = (
        requests.join(bundle.hint(agents.withColumn("_scoped", F.lit(True))), "agent", "left")
        .join(bundle.hint(entries.withColumn("_entry", F.lit(True))), ["agent", "source"], "left")
        .join(bundle.hint(named), ["agent", "source", "table"], "left")
    )
    return joined.select(*requests.columns, "_scoped", "_entry", F.coalesce("_named", "_wide").alias("_answer"))


def _told() -> Column:
    found = F.col("_answer")
    agent, source, table = (F.coalesce(F.col(c), F.lit("null")) for c in ("agent", "source", "table"))
    # The texts of the reasons.
    reason = (
        F.when(F.col("_scoped").isNull(), F.concat(F.lit("No scope defined for agent: "), agent))
        .when(
            F.col("_entry").isNull(),
            F.concat(F.lit("Agent "), agent, F.lit(" has no access to source: "), source),
        )
        .when(found.isNull(), F.concat(F.lit("Table "), table, F.lit(" not in scope for agent "), agent))
    )
    permitted = F.col("_scoped").isNotNull() & F.col("_entry").isNotNull() & found.isNotNull()
    return F.struct(
        permitted.alias("permitted"),
        reason.alias("reason"),
        F.when(permitted, found["fields"]).alias("fields"),
        F.when(permitted, found["filters"]).alias("filters"),
    )
