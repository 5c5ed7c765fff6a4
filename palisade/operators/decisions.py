"""Governance decisions for tables of requests.

``requests`` carries agent, source, table, operation and (for masked columns) columns. The
rules are SQL expressions over the columns the lookups add: ``_operation_ok``, ``_source_ok``,
``_rank``, ``_agent_cap`` and ``_agent_approve`` (from the agent's policy), ``_class``,
``_row_filter``, ``_table_cap`` and ``_table_approve`` (from the table's).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.classes import class_rank
from palisade.functions.querytext import WRITES
from palisade.operators.lookups import (
    agent_lookup,
    first_column_lookup,
    folded,
    masked_tables,
    source_lookup,
    splittable,
    with_agent_policy,
)
from palisade.sources.policy import MASKS, Bundle

# what the agent's policy says, worked out where that policy is at hand
OPERATION_OK = "coalesce(array_contains(_policy.allowed_ops, operation), false)"
# no list, or an empty one, opens every source
SOURCE_OK = (
    "(_policy.allowed_sources IS NULL OR size(_policy.allowed_sources) = 0"
    " OR coalesce(array_contains(_policy.allowed_sources, source), false))"
)
AGENT_SIDE = (
    f"{OPERATION_OK} AS _operation_ok",
    f"{SOURCE_OK} AS _source_ok",
    "_policy.rank AS _rank",
    "_policy.max_rows AS _agent_cap",
    "_policy.approve_writes AS _agent_approve",
)

CLASS_OK = f"{class_rank('_class')} <= _rank"
ALLOWED = f"(_operation_ok AND _source_ok AND {CLASS_OK})"
# The texts of the reasons.
REASON = f"""CASE
    WHEN NOT _operation_ok THEN
        concat('Agent ', ifnull(agent, 'null'), ' is not allowed to perform ', ifnull(operation, 'null'), ' operations')
    WHEN NOT _source_ok THEN
        concat('Agent ', ifnull(agent, 'null'), ' is not allowed to access source: ', ifnull(source, 'null'))
    WHEN NOT {CLASS_OK} THEN
        concat('Agent ', ifnull(agent, 'null'), ' cannot access ', _class, '-classified data in ',
            ifnull(source, 'null'), '.', ifnull(table, 'null')) END"""
# the smaller of two caps; 0 means no cap
ROW_CAP = """CASE WHEN ifnull(_table_cap, 0) > 0 AND _agent_cap > 0 THEN least(_table_cap, _agent_cap)
    ELSE greatest(ifnull(_table_cap, 0), _agent_cap) END"""
APPROVAL = f"""ifnull(operation IN {WRITES}, false) AND (_agent_approve OR ifnull(_table_approve, true))"""

DECISION = f"""named_struct(
    'allowed', {ALLOWED},
    'reason', {REASON},
    'masked_columns', CASE WHEN {ALLOWED} AND size(_masks) > 0 THEN _masks END,
    'row_filter', CASE WHEN {ALLOWED} THEN _row_filter END,
    'max_rows', CAST(CASE WHEN {ALLOWED} THEN {ROW_CAP} ELSE 0 END AS bigint),
    'requires_approval', {ALLOWED} AND {APPROVAL})"""
UNGOVERNED = f"""named_struct(
    'allowed', true,
    'reason', CAST(NULL AS string),
    'masked_columns', CAST(NULL AS {MASKS.simpleString()}),
    'row_filter', CAST(NULL AS string),
    'max_rows', CAST(0 AS bigint),
    'requires_approval', false)"""


def with_table_policy(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """Add _class, _row_filter, _table_cap, _table_approve and _table_masks by source and
    (source, table)."""
    renamed = {
        "classification": "_table_class",
        "row_filter": "_row_filter",
        "max_rows": "_table_cap",
        "approve_writes": "_table_approve",
        "masks": "_table_masks",
    }
    tables = masked_tables(bundle).select("source", "table", *[F.col(c).alias(n) for c, n in renamed.items()])
    sources = source_lookup(bundle).select("source", F.col("default_class").alias("_default_class"))
    joined = requests.join(bundle.hint(sources), "source", "left").join(bundle.hint(tables), ["source", "table"], "left")
    label = "coalesce(nullif(_table_class, ''), nullif(_default_class, ''), 'internal') AS _class"
    return joined.selectExpr(*_quoted(requests.columns), label, *[n for n in renamed.values() if n != "_table_class"])


# the masked ones among the requested columns, in policy order
MASKS_ASKED = "filter(_table_masks, m -> array_contains(transform(columns, c -> lower(c)), lower(m.name)))"


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def column_policies_of(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """One row per requested column that has a policy."""
    asked = requests.select("*", F.explode("columns").alias("name"))
    own = splittable(first_column_lookup(bundle), "source")
    return asked.join(bundle.hint(own), ["source", "table", "name"])


def with_policies(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """All lookups of a decision. With a small bundle they are broadcast and the requests do
    not move; otherwise Catalyst decides by the size of the resolved tables. Of the agent's
    policy only flags and numbers travel on."""
    agent_side = with_agent_policy(requests, bundle, "_policy").selectExpr(*_quoted(requests.columns), *AGENT_SIDE)
    return with_table_policy(agent_side, bundle)


def decide(requests: DataFrame, bundle: Bundle, name: str = "decision") -> DataFrame:
    """Add struct<allowed, reason, masked_columns, row_filter, max_rows, requires_approval>.

    The first failing test gives the reason: operation, source, classification.
    """
    if bundle.small or requests.isStreaming or not bundle.enabled:  # one narrow pass; a stream joins row by row
        return judged(requests, bundle, name)
    keys = [c for c in ("agent", "source", "table", "operation", "columns") if c in requests.columns]
    return folded(requests, keys, lambda asked: judged(asked, bundle, name))


def judged(asked: DataFrame, bundle: Bundle, name: str) -> DataFrame:
    """``decide`` row by row, for requests that are distinct already."""
    if not bundle.enabled:
        return asked.withColumn(name, F.expr(UNGOVERNED))
    masks = F.expr(MASKS_ASKED) if "columns" in asked.columns else F.lit(None).cast(MASKS)
    found = with_policies(asked, bundle).withColumn("_masks", masks)
    return found.select(*asked.columns, F.expr(DECISION).alias(name))


def preflight(pairs: DataFrame, bundle: Bundle) -> DataFrame:
    """May this agent read this table at all? Adds allowed and reason."""
    asked = pairs.withColumn("operation", F.lit("SELECT"))
    answered = decide(asked, bundle, "_decision")
    return answered.select(*pairs.columns, "_decision.allowed", "_decision.reason")


def access_matrix(pairs: DataFrame, bundle: Bundle) -> DataFrame:
    """Preflight of every distinct (agent, source, table), e.g. all those of a log or a scope. They are folded here, and
    so not once more on the way to their answers."""
    asked = pairs.select("agent", "source", "table").distinct().withColumn("operation", F.lit("SELECT"))
    answered = judged(asked, bundle, "_decision")
    return answered.select("agent", "source", "table", "_decision.allowed", "_decision.reason")


def clearance_coverage(agent_sources: DataFrame, catalog: DataFrame, bundle: Bundle) -> DataFrame:
    """How many of a source's tables each agent may read, for (agent, source) pairs.

    The catalog (source, table) shrinks to one histogram over the seven ranks per source
    before it meets the agents, so agents and tables are never paired one by one.
    """
    ranked = with_table_policy(catalog.select("source", "table").distinct(), bundle)
    per_rank = ranked.groupBy("source", F.expr(class_rank("_class")).alias("rank")).agg(F.count("*").alias("n"))
    histogram = per_rank.groupBy("source").agg(
        F.collect_list(F.struct("rank", "n")).alias("_ranks"), F.sum("n").alias("tables_total")
    )
    pairs = agent_sources.select("agent", "source").distinct().join(splittable(histogram, "source"), "source")
    pairs = with_agent_policy(pairs, bundle, "_policy")
    cleared = "aggregate(filter(_ranks, r -> r.rank <= _policy.rank), 0L, (acc, r) -> acc + r.n)"
    readable = "coalesce(array_contains(_policy.allowed_ops, 'SELECT'), false) AND " + SOURCE_OK
    return pairs.selectExpr(
        "agent", "source", "tables_total", f"CASE WHEN {readable} THEN {cleared} ELSE 0L END AS tables_allowed"
    )


def _changed(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def what_if(requests: DataFrame, before: Bundle, after: Bundle) -> DataFrame:
    """Requests whose decision changes between two policy sets. Both decisions are made in
    the same row, so the requests are read once and not joined with themselves."""
    both = decide(decide(requests, before, "before"), after, "after")
    return both.filter(_changed("before", "after"))


def _changed_keys(before: DataFrame, after: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, flag): keys whose lookup row (keys, state) is not the same in both."""
    a, b = before.withColumnRenamed("state", "_before"), after.withColumnRenamed("state", "_after")
    met = a.join(b, keys, "full_outer").filter(_changed("_before", "_after"))
    return splittable(met.select(*keys, F.lit(True).alias(flag)), keys[0])


def touched_by(asked: DataFrame, before: Bundle, after: Bundle) -> DataFrame:
    """The requests that a change of policies may concern: those of an agent, a source or a table whose policy is not the
    same before and after, and, if the default policy changes, those of agents without one of their own."""
    if before.enabled != after.enabled:
        return asked
    if not before.enabled:
        return asked.limit(0)
    columns = ("classification", "row_filter", "max_rows", "approve_writes", "masks")
    lookups = (
        (["agent"], lambda b: agent_lookup(b).withColumnRenamed("agent_policy", "state")),
        (["source"], lambda b: source_lookup(b).select("source", F.struct("default_class").alias("state"))),
        (["source", "table"], lambda b: masked_tables(b).select("source", "table", F.struct(*columns).alias("state"))),
    )
    found, hit = asked, F.lit(False)
    for k, (keys, lookup) in enumerate(lookups):
        changed = _changed_keys(lookup(before), lookup(after), keys, f"_touched{k}")
        found = found.join(before.hint(changed) if after.small else changed, keys, "left")
        hit = hit | F.col(f"_touched{k}").isNotNull()
    own = {k: v for k, v in before.default_agent.items() if k not in ("pos", "agent")}
    if own != {k: v for k, v in after.default_agent.items() if k not in ("pos", "agent")}:
        known = agent_lookup(after).select("agent", F.lit(True).alias("_known"))
        found = found.join(after.hint(known), "agent", "left")
        hit = hit | F.col("_known").isNull()
    return found.filter(hit).select(*asked.columns)


def what_if_touched(requests: DataFrame, before: Bundle, after: Bundle) -> DataFrame:
    """``what_if`` that judges only what the change touches: the log is folded to its distinct requests, those are met with
    the keys that the change concerns, and what is left of them is judged twice and met with the log."""
    keys = [c for c in ("agent", "source", "table", "operation", "columns") if c in requests.columns]
    judged = what_if(touched_by(requests.select(*keys).distinct(), before, after), before, after)
    a, b = requests.alias("a"), judged.alias("b")
    same = reduce(and_, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    return a.join(b, same).select("a.*", "b.before", "b.after")


def decision_diff(before: DataFrame, after: DataFrame, key: str = "request_id") -> DataFrame:
    """Changed, added and dropped decisions between two stored runs (columns key, decision)."""
    a = before.select(key, F.col("decision").alias("before"))
    b = after.select(key, F.col("decision").alias("after"))
    return a.join(b, key, "full_outer").filter(_changed("before", "after"))
