"""Governed DataFrames: row filter, residency, scope filter, masks, scope columns, row cap.

Filters see raw values, everything after them sees masked ones. All of it sits beneath
whatever the caller does with the frame, so neither an alias nor a join undoes a mask.

Spark has no security barrier: an expression of the caller's that raises an error may be
evaluated before the row filter and so betray that a filtered row exists. ``barrier=True``
writes the governed rows to the shared folder first and reads them back.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.classes import rank_of
from palisade.functions.masking import REDACTED, mask_frame, masked_names
from palisade.functions.predicates import equality_filter
from palisade.operators.lookups import first_match
from palisade.operators.scope import gathered, rule_items
from palisade.operators.single import judge_one
from palisade.session import materialise
from palisade.sources.policy import Bundle, fetch, typed_value
from palisade.sources.registry import Registry


class AccessDenied(PermissionError):
    def __init__(self, stage: str, reason: str):
        self.stage = stage
        self.reason = reason
        super().__init__(reason)


@dataclass(frozen=True)
class ResidencyKey:
    """Where a table keeps its region: in ``column`` itself, or through the lookup
    ``via`` (key, region) that ``column`` points into."""

    column: str
    via: DataFrame | None = None


@dataclass(frozen=True)
class Access:
    """What one agent may do with one table."""

    agent: str
    source: str
    table: str
    max_rows: int
    requires_approval: bool
    row_filter: str | None = None
    residency: Sequence[str] | None = None
    fields: Sequence[str] | None = None
    filters: Mapping[str, object] = field(default_factory=dict)
    columns: Sequence[Mapping] = ()
    rank: int = -1


@dataclass(frozen=True)
class GovernedTable:
    df: DataFrame
    access: Access
    masked: Sequence[Mapping]  # columns really masked: name, strategy, format

    def capped(self) -> DataFrame:
        """With the row cap as the outermost step."""
        return cap_rows(self.df, self.access.max_rows)

    def masked_requested(self, names: Iterable[str]) -> list[str]:
        """Masked ones among the named columns, in policy order."""
        asked = {n.lower() for n in names}
        return [m["name"] for m in self.masked if m["name"].lower() in asked]


def policy_slice(bundle: Bundle, agent: str, source: str, tables: Sequence[str]) -> dict[str, list[dict]]:
    """The policy rows that concern one agent and a few tables of one source."""
    wanted = [t.lower() for t in tables]
    if bundle.small:
        rows = bundle.rows
        return {
            "sources": [r for r in rows["sources"] if r["name"] == source],
            "scope_rules": [r for r in rows["scope_rules"] if r["agent"] == agent],
            "agent_policy": [r for r in rows["agent_policy"] if r["agent"] == agent],
            "source_policy": [r for r in rows["source_policy"] if r["source"] == source],
        } | {
            name: [r for r in rows[name] if r["source"] == source and r["table"].lower() in wanted]
            for name in ("table_policy", "column_policy")
        }
    agent_rows = bundle.agent_policy.filter(F.col("agent") == agent)
    source_rows = bundle.source_policy.filter(F.col("source") == source)
    return {
        "sources": fetch(bundle.sources.filter(F.col("name") == source).limit(1)),
        "scope_rules": _merged_rules(bundle, agent, source, wanted),
        "agent_policy": fetch(first_match(agent_rows, ["agent"], ["pos"])),
        "source_policy": fetch(first_match(source_rows, ["source"], ["source_pos"])),
    } | {name: fetch(rows) for name, rows in _chosen(bundle, source, wanted).items()}


def _chosen(bundle: Bundle, source: str, wanted: Sequence[str]) -> dict[str, DataFrame]:
    """The first policy of each table in the first entry of its source, and its columns."""
    entry = bundle.source_policy.filter(F.col("source") == source).agg(F.min("source_pos").alias("source_pos"))
    own = bundle.table_policy.filter((F.col("source") == source) & F.lower("table").isin(wanted))
    own = own.filter(F.col("source_pos") == entry.scalar()).withColumn("_name", F.lower("table"))
    own = first_match(own, ["source", "_name"], ["table_pos"]).drop("_name")
    at = ["source", "source_pos", "table", "table_pos"]
    columns = bundle.column_policy.filter((F.col("source") == source) & F.lower("table").isin(wanted))
    return {"table_policy": own, "column_policy": columns.join(own.select(*at), at, "left_semi")}


def _merged_rules(bundle: Bundle, agent: str, source: str, wanted: Sequence[str]) -> list[dict]:
    """One agent's rules, merged by Spark: at most one for each wanted table, whose fields and
    filters are as many as the columns they name, and one that shows where the agent may go."""
    rules = bundle.scope_rules.filter(F.col("agent") == agent)
    rules = rules.filter(F.col("scope_pos") == rules.agg(F.min("scope_pos")).scalar())
    listed = rules.filter(F.col("source") == source)
    listed = listed.filter(F.col("source_pos") == listed.agg(F.min("source_pos")).scalar())
    at = {"agent": agent, "scope_pos": 0, "source_pos": 0}
    if not fetch(rules.select("agent").limit(1)):
        return []
    if not fetch(listed.select("agent").limit(1)):
        return [{**at, "source": None, "rule_pos": None}]
    asked = F.array(*[F.lit(w) for w in wanted])
    met = listed.filter("rule_pos is not null").withColumn(
        "table", F.explode(F.when(F.col("table").isNull(), asked).otherwise(F.array(F.lower("table"))))
    )
    merged = gathered(rule_items(met.filter(F.col("table").isin(wanted)), ["table"]), ["table"])
    at["source"] = source
    return [{**at, "rule_pos": None}, *[{**at, "rule_pos": 0, **row} for row in fetch(merged)]]


def check_access(
    bundle: Bundle, agent: str, source: str, tables: Sequence[str], operation: str = "SELECT"
) -> dict[str, Access]:
    """Access to each table, or AccessDenied.

    Table names compare without regard to case here, as Spark resolves them, so that a
    slip of case cannot step around a table policy.
    """
    rows = policy_slice(bundle, agent, source, tables)
    if not rows["sources"]:
        raise AccessDenied("unknown_source", f"Unknown source: {source}")
    out = {}
    for table in dict.fromkeys(tables):
        verdict = judge_one(rows, bundle.enabled, bundle.default_agent, agent, source, table, operation)
        if verdict.stage:
            raise AccessDenied(verdict.stage, verdict.reason)
        policy = verdict.table_policy
        out[table] = Access(
            agent=agent,
            source=source,
            table=table,
            max_rows=verdict.max_rows,
            requires_approval=verdict.requires_approval,
            row_filter=policy.get("row_filter"),
            residency=policy.get("residency"),
            fields=verdict.fields,
            filters={f["key"]: typed_value(f) for f in verdict.filters or []},
            columns=verdict.columns,
            rank=verdict.rank,
        )
    return out


def row_level(df: DataFrame, predicate: str | None) -> DataFrame:
    return df if predicate is None else df.filter(F.expr(predicate))


def reside(df: DataFrame, regions: Sequence[str] | None, key: ResidencyKey | None) -> DataFrame:
    """Rows of the listed regions only. A restricted table whose region is unknown stays shut."""
    if not regions:
        return df
    if key is None:
        raise AccessDenied("governance_denied", "Residency is restricted but the table has no region column")
    if key.via is None:
        return df.filter(F.col(key.column).isin(*regions))
    homes = key.via.filter(F.col("region").isin(*regions)).select(F.col("key").alias(key.column))
    return df.join(homes, key.column, "left_semi")


def scope_rows_of(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.filter(equality_filter(filters)) if filters else df


def scope_fields_of(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """Exactly the scope's fields in rule order; a field the data lacks is an error."""
    if not fields or list(fields) == ["*"]:
        return df
    return df.select(*[F.col(f"`{f}`").alias(f) for f in fields])


def clear_columns(df: DataFrame, policies: Iterable[Mapping], rank: int, mode: str) -> DataFrame:
    """Columns above the agent's clearance: ``drop`` them, or ``redact`` them to a literal
    that does not even read the raw column."""
    above = {p["name"].lower() for p in policies if rank_of(p["classification"]) > rank}
    if mode == "drop":
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in above])
    if mode != "redact":
        raise ValueError(f"column clearance must be drop or redact, not {mode}")
    return df.select(
        *[F.lit(REDACTED).alias(c) if c.lower() in above else F.col(f"`{c}`") for c in df.columns]
    )


def cap_rows(df: DataFrame, cap: int) -> DataFrame:
    return df.limit(cap) if cap > 0 else df


def rows_in_reach(df: DataFrame, access: Access, residency: ResidencyKey | None = None) -> DataFrame:
    """The raw rows the agent may touch."""
    df = reside(row_level(df, access.row_filter), access.residency, residency)
    return scope_rows_of(df, access.filters)


def own_reach(df: DataFrame, access: Access, residency: ResidencyKey | None = None) -> Column:
    """The condition that marks the rows in reach of a frame that ``in_reach`` has prepared."""
    own = F.lit(True) if access.row_filter is None else F.coalesce(F.expr(access.row_filter), F.lit(False))
    own = own & F.coalesce(equality_filter(access.filters), F.lit(False))
    if not access.residency:
        return own
    if residency is None:
        raise AccessDenied("governance_denied", "Residency is restricted but the table has no region column")
    if residency.via is None:
        return own & F.coalesce(F.col(residency.column).isin(*access.residency), F.lit(False))
    return own & F.col("_home").isNotNull()


def in_reach(df: DataFrame, access: Access, residency: ResidencyKey | None = None) -> tuple[DataFrame, Column]:
    """For writes: the whole frame and the condition that marks the rows in reach. The frame
    gains helper columns only where residency goes through a lookup."""
    if access.residency and residency is not None and residency.via is not None:
        homes = residency.via.filter(F.col("region").isin(*access.residency))
        homes = homes.select(F.col("key").alias(residency.column), F.lit(True).alias("_home")).distinct()
        df = df.join(homes, residency.column, "left")
    return df, own_reach(df, access, residency)


def govern(
    df: DataFrame,
    access: Access,
    *,
    residency: ResidencyKey | None = None,
    salt: str = "",
    compat: bool = False,
    hide_nulls: bool = False,
    column_clearance: str | None = None,
) -> GovernedTable:
    """Works on batch and streaming frames alike; a stream simply has no row cap."""
    rows = rows_in_reach(df, access, residency)
    shown = mask_frame(rows, access.columns, salt=salt, compat=compat, hide_nulls=hide_nulls)
    shown = scope_fields_of(shown, access.fields)
    if column_clearance:
        shown = clear_columns(shown, access.columns, access.rank, column_clearance)
    return GovernedTable(shown, access, masked_names(shown.columns, access.columns))


def governed_table(
    spark: SparkSession,
    registry: Registry,
    bundle: Bundle,
    agent: str,
    source: str,
    table: str,
    *,
    residency: ResidencyKey | None = None,
    barrier: bool = False,
    **options,
) -> GovernedTable:
    """One table as one agent may see it; raises AccessDenied."""
    access = check_access(bundle, agent, source, [table])[table]
    result = govern(registry.load(spark, source, table), access, residency=residency, **options)
    if not barrier:
        return result
    return GovernedTable(materialise(result.df, "governed"), access, result.masked)
