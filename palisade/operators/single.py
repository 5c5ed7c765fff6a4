"""One request on the driver: the decision behind a governed table.

A governed query needs the verdict on a handful of tables before its plan can be built, so
it is worked out from the few policy rows that concern them. The batch operators state the
same rules as joins; the tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from palisade.functions.classes import rank_of
from palisade.functions.querytext import WRITES

Rows = Iterable[Mapping]


def first_rows(rows: Rows, keys: Sequence[str], order: Sequence[str]) -> list[dict]:
    """The first row of each key."""
    first: dict[tuple, Mapping] = {}
    for row in sorted(rows, key=lambda r: tuple(r[o] for o in order)):
        first.setdefault(tuple(row[k] for k in keys), row)
    return list(first.values())


def chosen_tables(rows: Mapping[str, list[dict]], fold=lambda name: name) -> list[dict]:
    """Table policies of the first policy entry of their source, first one per table."""
    entry = {r["source"]: r["source_pos"] for r in first_rows(rows["source_policy"], ["source"], ["source_pos"])}
    own = [{**r, "_name": fold(r["table"])} for r in rows["table_policy"] if entry.get(r["source"]) == r["source_pos"]]
    found = first_rows(own, ["source", "_name"], ["table_pos"])
    return [{k: v for k, v in r.items() if k != "_name"} for r in found]


def chosen_columns(rows: Mapping[str, list[dict]], fold=lambda name: name) -> list[dict]:
    """Column policies of the chosen table policies in list order."""
    at = ("source", "source_pos", "table", "table_pos")
    chosen = {tuple(t[k] for k in at) for t in chosen_tables(rows, fold)}
    own = [r for r in rows["column_policy"] if tuple(r[k] for k in at) in chosen]
    return sorted(own, key=lambda r: (r["source"], r["table"], r["pos"]))


def active_rule_rows(rules: Rows) -> list[Mapping]:
    """Rules of each agent's first scope and, in it, of the first entry of each source."""
    rules = list(rules)
    scope = {r["agent"]: r["scope_pos"] for r in first_rows(rules, ["agent"], ["scope_pos"])}
    rules = [r for r in rules if r["scope_pos"] == scope[r["agent"]]]
    entry = {
        (r["agent"], r["source"]): r["source_pos"] for r in first_rows(rules, ["agent", "source"], ["source_pos"])
    }
    return [r for r in rules if r["source_pos"] == entry[r["agent"], r["source"]]]


def merge_one(rules: Rows) -> tuple[list[str] | None, list[dict] | None]:
    """Fields in first-mention order and, per filter key, the value named last."""
    fields: dict[str, None] = {}
    filters: dict[str, Mapping] = {}
    for rule in sorted(rules, key=lambda r: r["rule_pos"]):
        fields |= dict.fromkeys(rule.get("fields") or [])
        filters |= {f["key"]: f for f in rule.get("filters") or []}
    return list(fields) or None, list(filters.values()) or None


def merge_rule_rows(rules: Rows) -> list[dict]:
    """One row per named (agent, source, table) and one without a table per open source."""
    groups: dict[tuple, dict[str | None, list]] = {}
    for rule in active_rule_rows(rules):
        if rule.get("rule_pos") is not None:
            group = groups.setdefault((rule["agent"], rule["source"]), {})
            group.setdefault(rule.get("table"), []).append(rule)
    out = []
    for (agent, source), tables in groups.items():
        wide = tables.get(None, [])
        for table, own in tables.items():
            fields, filters = merge_one(own if table is None else own + wide)
            out.append({"agent": agent, "source": source, "table": table, "fields": fields, "filters": filters})
    return out


@dataclass(frozen=True)
class Verdict:
    stage: str | None = None  # None when allowed
    reason: str | None = None
    fields: list[str] | None = None
    filters: list[dict] | None = None
    max_rows: int = 0
    requires_approval: bool = False
    rank: int = -1
    table_policy: Mapping = field(default_factory=dict)
    columns: Sequence[Mapping] = ()


def judge_one(
    rows: Mapping[str, list[dict]],
    enabled: bool,
    default_agent: Mapping,
    agent: str,
    source: str,
    table: str,
    operation: str,
) -> Verdict:
    """Scope first, then operation, source and classification. Table names match in any case.
    The texts of the reasons are fixed values."""
    scoped = active_rule_rows(r for r in rows["scope_rules"] if r["agent"] == agent)
    if not scoped:
        return Verdict("scope_denied", f"Access denied: No scope defined for agent: {agent}")
    listed = [r for r in scoped if r["source"] == source]
    if not listed:
        return Verdict("scope_denied", f"Access denied: Agent {agent} has no access to source: {source}")
    hits = [
        r
        for r in listed
        if r.get("rule_pos") is not None and (r.get("table") is None or r["table"].lower() == table.lower())
    ]
    if not hits:
        return Verdict("scope_denied", f"Access denied: Table {table} not in scope for agent {agent}")
    fields, filters = merge_one(hits)
    if not enabled:
        return Verdict(fields=fields, filters=filters)

    explicit = first_rows((r for r in rows["agent_policy"] if r["agent"] == agent), ["agent"], ["pos"])
    policy = explicit[0] if explicit else default_agent
    who = f"Governance denied: Agent {agent}"
    if operation not in (policy["allowed_ops"] or []):
        return Verdict("governance_denied", f"{who} is not allowed to perform {operation} operations")
    if policy.get("allowed_sources") and source not in policy["allowed_sources"]:
        return Verdict("governance_denied", f"{who} is not allowed to access source: {source}")
    entry = first_rows((r for r in rows["source_policy"] if r["source"] == source), ["source"], ["source_pos"])
    tables = [t for t in chosen_tables(rows, str.lower) if t["source"] == source and t["table"].lower() == table.lower()]
    own = tables[0] if tables else {}
    label = own.get("classification") or (entry[0]["default_class"] if entry else None) or "internal"
    rank = max((rank_of(c) for c in policy["allowed_classes"] or []), default=-1)
    if rank_of(label) > rank:
        return Verdict("governance_denied", f"{who} cannot access {label}-classified data in {source}.{table}")

    caps = [c for c in (own.get("max_rows") or 0, policy["max_rows"]) if c > 0]
    approval = operation in WRITES and (
        bool(policy.get("approve_writes")) or own.get("approve_writes") in (True, None)
    )
    return Verdict(
        fields=fields,
        filters=filters,
        max_rows=min(caps, default=0),
        requires_approval=approval,
        rank=rank,
        table_policy=own,
        columns=[c for c in chosen_columns(rows, str.lower) if c["table"].lower() == table.lower()],
    )
