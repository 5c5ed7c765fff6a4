"""Policies as tables.

Every list of the configuration becomes a table whose ``pos`` columns keep the list order,
because lookups take the first match. A bundle built from a configuration is small and its
row count is known; a bundle of stored tables may be any size. Joins ask ``bundle.small``
before they hint a broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palisade.sources.config import AGENT_DEFAULTS, AUDIT_LOG_DAYS, DEFAULT_AGENT, check_config

#: A configuration with up to so many rows a table is resolved on the driver.
BROADCAST_ROWS = 100_000

LONG, INT, TEXT, FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


FILTERS = T.ArrayType(struct(key=TEXT, value=TEXT, type=TEXT))
MASKS = T.ArrayType(struct(name=TEXT, strategy=TEXT, format=TEXT))

SCHEMAS: dict[str, T.StructType] = {
    "sources": struct(
        pos=LONG, name=TEXT, type=TEXT, host=TEXT, database=TEXT, port=INT, url=TEXT, project=TEXT, region=TEXT,
        instance=TEXT,
    ),
    "scope_rules": struct(
        scope_pos=LONG, source_pos=LONG, rule_pos=LONG, agent=TEXT, source=TEXT, table=TEXT, fields=TEXTS,
        filters=FILTERS,
    ),
    "source_policy": struct(source_pos=LONG, source=TEXT, default_class=TEXT),
    "table_policy": struct(
        source_pos=LONG, table_pos=LONG, source=TEXT, table=TEXT, classification=TEXT, row_filter=TEXT,
        max_rows=LONG, approve_writes=FLAG, residency=TEXTS,
    ),
    "column_policy": struct(
        source_pos=LONG, table_pos=LONG, pos=LONG, source=TEXT, table=TEXT, name=TEXT, classification=TEXT,
        masking=TEXT, mask_format=TEXT,
    ),
    "agent_policy": struct(
        pos=LONG, agent=TEXT, allowed_classes=TEXTS, max_rows=LONG, max_concurrency=LONG, timeout_ms=LONG,
        allowed_ops=TEXTS, approve_writes=FLAG, allowed_sources=TEXTS,
    ),
}
_SETTINGS = struct(enabled=FLAG, default_agent=SCHEMAS["agent_policy"], audit_log_days=INT)


def local_frame(spark: SparkSession, rows: list[Mapping], schema: T.StructType) -> DataFrame:
    """A small frame whose exact size Catalyst knows (a LocalRelation, through Arrow)."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema)), schema)


def fetch(df: DataFrame) -> list[dict]:
    """Rows of one agent's merged scope, or of one table's policy: as many as the table has columns."""
    return [r.asDict(recursive=True) for r in df.collect()]


def filter_value(value) -> dict:
    """Text and type tag of a scope filter's JSON value."""
    match value:
        case None:
            return {"value": None, "type": "null"}
        case bool():
            return {"value": "true" if value else "false", "type": "boolean"}
        case int() | float():
            return {"value": json.dumps(value), "type": "number"}
        case str():
            return {"value": value, "type": "string"}
    return {"value": json.dumps(value), "type": "json"}


def typed_value(entry: Mapping):
    """Back from text and type tag; lists and objects come back as such (and are refused later)."""
    if entry["type"] == "string":
        return entry["value"]
    return None if entry["type"] == "null" else json.loads(entry["value"])


def agent_row(pos: int, policy: Mapping) -> dict:
    return {
        "pos": pos,
        "agent": policy["agent"],
        "allowed_classes": policy["allowedClassifications"],
        "max_rows": policy["maxRowsPerQuery"],
        "max_concurrency": policy["maxConcurrency"],
        "timeout_ms": policy["queryTimeoutMs"],
        "allowed_ops": policy["allowedOperations"],
        "approve_writes": policy.get("requireApprovalForWrites"),
        "allowed_sources": policy.get("allowedSources"),
    }


def scope_rows(scope_pos: int, scope: Mapping) -> list[dict]:
    """One row per rule; a source without rules keeps one row with an empty ``rule_pos``."""
    rows = []
    for source_pos, source in enumerate(scope["sources"]):
        base = {"scope_pos": scope_pos, "source_pos": source_pos, "agent": scope["agent"], "source": source["name"]}
        rows += [
            {
                **base,
                "rule_pos": rule_pos,
                "table": rule.get("table") or None,
                "fields": rule.get("fields"),
                "filters": None
                if rule.get("filters") is None
                else [{"key": k, **filter_value(v)} for k, v in rule["filters"].items()],
            }
            for rule_pos, rule in enumerate(source["rules"])
        ] or [base]
    return rows


def source_row(pos: int, source: Mapping) -> dict:
    """A source without its credentials."""
    wanted = ("host", "database", "port", "url", "project", "region", "instance")
    return {"pos": pos, "name": source["name"], "type": source["type"]} | {
        k: source["connection"].get(k) for k in wanted
    }


def _policy_rows(config: Mapping) -> dict[str, list[dict]]:
    g = config["governance"]
    rows: dict[str, list[dict]] = {name: [] for name in SCHEMAS}
    rows["sources"] = [source_row(i, s) for i, s in enumerate(config["sources"])]
    rows["agent_policy"] = [agent_row(i, a) for i, a in enumerate(g["agentPolicies"])]
    for i, scope in enumerate(config["scopes"]):
        rows["scope_rules"] += scope_rows(i, scope)
    for i, sp in enumerate(g["sourcePolicies"]):
        rows["source_policy"].append(
            {"source_pos": i, "source": sp["source"], "default_class": sp["defaultClassification"]}
        )
        for j, tp in enumerate(sp["tables"]):
            at = {"source_pos": i, "table_pos": j, "source": sp["source"], "table": tp["table"]}
            rows["table_policy"].append(
                {
                    **at,
                    "classification": tp["classification"],
                    "row_filter": tp["rowFilter"],
                    "max_rows": tp["maxRows"],
                    "approve_writes": tp["requireApprovalForWrites"],
                    "residency": tp["residency"],
                }
            )
            rows["column_policy"] += [
                {
                    **at,
                    "pos": k,
                    "name": cp["name"],
                    "classification": cp["classification"],
                    "masking": cp["masking"],
                    "mask_format": cp["maskFormat"],
                }
                for k, cp in enumerate(tp["columns"])
            ]
    return rows


@dataclass(frozen=True)
class Bundle:
    """All policy tables, plus the few settings that are not tables.

    ``rows`` holds the same tables as plain rows while their number is known to be small;
    lookups then resolve on the driver and are broadcast. Without it the tables may be any
    size and every lookup is a distributed join; ``resolved`` holds lookups worked out ahead.
    """

    sources: DataFrame
    scope_rules: DataFrame
    source_policy: DataFrame
    table_policy: DataFrame
    column_policy: DataFrame
    agent_policy: DataFrame
    enabled: bool = True
    default_agent: dict = field(default_factory=lambda: agent_row(-1, {**AGENT_DEFAULTS, **DEFAULT_AGENT}))
    audit_log_days: int = AUDIT_LOG_DAYS
    rows: Mapping[str, list[dict]] | None = field(default=None, repr=False)
    resolved: Mapping[str, DataFrame] = field(default_factory=dict, repr=False)

    @staticmethod
    def from_config(spark: SparkSession, raw: Mapping) -> Bundle:
        config = check_config(raw)
        rows = _policy_rows(config)
        g = config["governance"]
        return Bundle(
            **{name: local_frame(spark, rows[name], SCHEMAS[name]) for name in SCHEMAS},
            enabled=g["enabled"],
            default_agent=agent_row(-1, g["defaultAgentPolicy"]),
            audit_log_days=g["retention"]["auditLogDays"],
            rows=rows if all(len(r) <= BROADCAST_ROWS for r in rows.values()) else None,
        )

    @staticmethod
    def from_tables(spark: SparkSession, **given) -> Bundle:
        """Tables of any size; those not given are empty. Extra keywords are settings."""
        tables = {n: given.pop(n, None) for n in SCHEMAS}
        tables = {n: local_frame(spark, [], SCHEMAS[n]) if d is None else d for n, d in tables.items()}
        return Bundle(**tables, **given)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bundle:
        s = spark.read.json(f"{path}/settings", schema=_SETTINGS).first()
        return Bundle(
            **{n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in SCHEMAS},
            enabled=s["enabled"],
            default_agent=s["default_agent"].asDict(recursive=True),
            audit_log_days=s["audit_log_days"],
        )

    def write(self, path: str) -> None:
        for name in SCHEMAS:
            getattr(self, name).write.parquet(f"{path}/{name}")
        settings = {
            "enabled": self.enabled,
            "default_agent": self.default_agent,
            "audit_log_days": self.audit_log_days,
        }
        local_frame(self.spark, [settings], _SETTINGS).write.json(f"{path}/settings")

    @property
    def spark(self) -> SparkSession:
        return self.scope_rules.sparkSession

    @property
    def small(self) -> bool:
        return self.rows is not None

    def localised(self, most: int = BROADCAST_ROWS) -> Bundle:
        """With ``rows`` if every table has at most ``most`` of them, else unchanged."""
        rows = {}
        for name in SCHEMAS:
            found = getattr(self, name).limit(most + 1).collect()
            if len(found) > most:
                return self
            rows[name] = [r.asDict(recursive=True) for r in found]
        return replace(self, rows=rows)

    def with_tables(self, **tables: DataFrame) -> Bundle:
        """Other tables; their size is unknown until ``localised`` checks it."""
        return replace(self, rows=None, resolved={}, **tables)

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast policy rows only while their number is known to be small."""
        return F.broadcast(df) if self.small else df
