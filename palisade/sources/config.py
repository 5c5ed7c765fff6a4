"""Reading and checking a policy configuration (a dict, or a YAML/JSON file)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from palisade.functions.classes import CLASSES
from palisade.functions.masking import STRATEGIES

# Fixed values of the configuration format.
OPERATIONS = ("SELECT", "INSERT", "UPDATE", "DELETE")
SOURCE_TYPES = (
    "postgres",
    "mysql",
    "mariadb",
    "cloud-sql-postgres",
    "cloud-sql-mysql",
    "alloydb",
    "bigquery",
    "spanner",
    "rest",
)
DEFAULT_AGENT = {
    "agent": "default",
    "allowedClassifications": ["public"],
    "maxRowsPerQuery": 100,
    "maxConcurrency": 1,
    "queryTimeoutMs": 10000,
    "allowedOperations": ["SELECT"],
}
AGENT_DEFAULTS = {
    "allowedClassifications": ["internal", "public"],
    "maxRowsPerQuery": 1000,
    "maxConcurrency": 5,
    "queryTimeoutMs": 30000,
    "allowedOperations": ["SELECT"],
    "requireApprovalForWrites": True,
}
AUDIT_LOG_DAYS = 365


class ConfigError(ValueError):
    """Every problem found, one ``path: message`` per line."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("Config validation failed:\n" + "\n".join(f"  {p}" for p in problems))


class _Checker:
    """Collects ``path: message`` problems; each check returns the value or its default. Paths
    and messages are fixed values."""

    def __init__(self):
        self.problems: list[str] = []

    def fail(self, path: str, message: str):
        self.problems.append(f"{path}: {message}")

    def get(self, node, path: str, key: str, kind, default=None, required=False):
        if not isinstance(node, Mapping):
            problem = f"{path or key}: Expected object, received {type(node).__name__}"
            if problem not in self.problems:  # once, however many keys are asked for
                self.problems.append(problem)
            return default
        value = node.get(key)
        if value is None:
            if required:
                self.fail(f"{path}.{key}".lstrip("."), "Required")
            return default
        wrong_bool = isinstance(value, bool) and kind is not bool
        if wrong_bool or not isinstance(value, kind):
            self.fail(f"{path}.{key}".lstrip("."), f"Expected {kind.__name__}, received {type(value).__name__}")
            return default
        return value

    def texts(self, node, path, key):
        values = self.get(node, path, key, list)
        for i, value in enumerate(values or []):
            if not isinstance(value, str):
                self.fail(f"{path}.{key}.{i}", f"Expected str, received {type(value).__name__}")
        return values

    def choice(self, node, path, key, allowed, default=None, required=False):
        value = self.get(node, path, key, str, default, required)
        if value is not None and value not in allowed:
            self.fail(f"{path}.{key}", f"Invalid value '{value}', expected one of {', '.join(allowed)}")
        return value

    def choices(self, node, path, key, allowed, default):
        values = self.get(node, path, key, list, default)
        for i, value in enumerate(values or []):
            if value not in allowed:
                self.fail(f"{path}.{key}.{i}", f"Invalid value '{value}', expected one of {', '.join(allowed)}")
        return values

    def whole(self, node, path, key, default, least):
        value = self.get(node, path, key, int, default)
        if value is not None and value < least:
            self.fail(f"{path}.{key}", f"Number must be at least {least}")
        return value


def load_config(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return check_config(json.loads(text))
    try:
        import yaml
    except ImportError as err:
        raise RuntimeError("YAML files need PyYAML; use a JSON file instead") from err
    return check_config(yaml.safe_load(text))


def check_config(raw: Mapping) -> dict:
    """The configuration with all defaults filled in; raises ConfigError with every problem."""
    c = _Checker()
    if not isinstance(raw, Mapping):
        raise ConfigError([f": Expected object, received {type(raw).__name__}"])
    out = {
        "sources": [
            check_source(c, s, f"sources.{i}") for i, s in enumerate(c.get(raw, "", "sources", list, [], True))
        ],
        "scopes": [check_scope(c, s, f"scopes.{i}") for i, s in enumerate(c.get(raw, "", "scopes", list, [], True))],
        "governance": _governance(c, c.get(raw, "", "governance", dict, {})),
        "audit": _audit(c, c.get(raw, "", "audit", dict, {})),
    }
    if c.problems:
        raise ConfigError(c.problems)
    return out


def check_source(c: _Checker, s: Mapping, path: str) -> dict:
    credentials = c.get(s, path, "credentials", dict, {}, True)
    if credentials and "apiKey" not in credentials:
        for key in ("host", "database", "username", "password"):
            c.get(credentials, f"{path}.credentials", key, str, required=True)
    elif credentials:
        credentials = {"headerName": "Authorization", **credentials}
    connection = c.get(s, path, "connection", dict, {}, True)
    for key in ("host", "database", "url", "project", "region", "instance"):
        c.get(connection, f"{path}.connection", key, str)
    c.get(connection, f"{path}.connection", "port", int)
    return {
        "type": c.choice(s, path, "type", SOURCE_TYPES, required=True),
        "name": c.get(s, path, "name", str, required=True),
        "connection": connection,
        "credentials": credentials,
    }


def check_scope(c: _Checker, s: Mapping, path: str) -> dict:
    agent = c.get(s, path, "agent", str, required=True)
    if agent == "":
        c.fail(f"{path}.agent", "Agent ID must not be empty")
    listed = c.get(s, path, "sources", list, required=True)
    if listed == []:
        c.fail(f"{path}.sources", "At least one source is required")
    sources = []
    for i, src in enumerate(listed or []):
        here = f"{path}.sources.{i}"
        name = c.get(src, here, "name", str, required=True)
        if name == "":
            c.fail(f"{here}.name", "Source name must not be empty")
        rules = []
        for j, rule in enumerate(c.get(src, here, "rules", list, [], True)):
            at = f"{here}.rules.{j}"
            rules.append(
                {
                    "table": c.get(rule, at, "table", str),
                    "fields": c.texts(rule, at, "fields"),
                    "filters": c.get(rule, at, "filters", dict),
                }
            )
        sources.append({"name": name, "rules": rules})
    return {"agent": agent, "sources": sources}


def _governance(c: _Checker, g: Mapping) -> dict:
    path = "governance"
    retention = c.get(g, path, "retention", dict, {})
    default = c.get(g, path, "defaultAgentPolicy", dict) or DEFAULT_AGENT
    return {
        "enabled": c.get(g, path, "enabled", bool, True),
        "sourcePolicies": [
            _source_policy(c, s, f"{path}.sourcePolicies.{i}")
            for i, s in enumerate(c.get(g, path, "sourcePolicies", list, []))
        ],
        "agentPolicies": [
            _agent_policy(c, a, f"{path}.agentPolicies.{i}")
            for i, a in enumerate(c.get(g, path, "agentPolicies", list, []))
        ],
        "defaultAgentPolicy": _agent_policy(c, default, f"{path}.defaultAgentPolicy"),
        "retention": {"auditLogDays": c.whole(retention, f"{path}.retention", "auditLogDays", AUDIT_LOG_DAYS, 1)},
    }


def _source_policy(c: _Checker, s: Mapping, path: str) -> dict:
    return {
        "source": c.get(s, path, "source", str, required=True),
        "defaultClassification": c.choice(s, path, "defaultClassification", CLASSES, "internal"),
        "tables": [
            _table_policy(c, t, f"{path}.tables.{i}") for i, t in enumerate(c.get(s, path, "tables", list, []))
        ],
    }


def _table_policy(c: _Checker, t: Mapping, path: str) -> dict:
    columns = []
    for i, col in enumerate(c.get(t, path, "columns", list, [])):
        at = f"{path}.columns.{i}"
        columns.append(
            {
                "name": c.get(col, at, "name", str, required=True),
                "classification": c.choice(col, at, "classification", CLASSES, required=True),
                "masking": c.choice(col, at, "masking", STRATEGIES, "none"),
                "maskFormat": c.get(col, at, "maskFormat", str),
            }
        )
    return {
        "table": c.get(t, path, "table", str, required=True),
        "classification": c.choice(t, path, "classification", CLASSES, required=True),
        "columns": columns,
        "rowFilter": c.get(t, path, "rowFilter", str),
        "maxRows": c.whole(t, path, "maxRows", 0, 0),
        "requireApprovalForWrites": c.get(t, path, "requireApprovalForWrites", bool, True),
        "residency": c.texts(t, path, "residency"),
    }


def _agent_policy(c: _Checker, a: Mapping, path: str) -> dict:
    d = AGENT_DEFAULTS
    return {
        "agent": c.get(a, path, "agent", str, required=True),
        "allowedClassifications": c.choices(
            a, path, "allowedClassifications", CLASSES, d["allowedClassifications"]
        ),
        "maxRowsPerQuery": c.whole(a, path, "maxRowsPerQuery", d["maxRowsPerQuery"], 0),
        "maxConcurrency": c.whole(a, path, "maxConcurrency", d["maxConcurrency"], 1),
        "queryTimeoutMs": c.whole(a, path, "queryTimeoutMs", d["queryTimeoutMs"], 1),
        "allowedOperations": c.choices(a, path, "allowedOperations", OPERATIONS, d["allowedOperations"]),
        "requireApprovalForWrites": c.get(
            a, path, "requireApprovalForWrites", bool, d["requireApprovalForWrites"]
        ),
        "allowedSources": c.texts(a, path, "allowedSources"),
    }


def _audit(c: _Checker, a: Mapping) -> dict:
    return {
        "enabled": c.get(a, "audit", "enabled", bool, True),
        "format": c.choice(a, "audit", "format", ("json", "jsonl"), "jsonl"),
        "output": c.get(a, "audit", "output", str),
    }


def checked_source(raw: Mapping) -> dict:
    """One source definition, validated."""
    c = _Checker()
    out = check_source(c, raw, "")
    if c.problems:
        raise ConfigError([p.lstrip(".") for p in c.problems])
    return out


def checked_scope(raw: Mapping) -> dict:
    """One agent scope, validated."""
    c = _Checker()
    out = check_scope(c, raw, "")
    if c.problems:
        raise ConfigError([p.lstrip(".") for p in c.problems])
    return out


def resolve_env(value: str) -> str:
    """``${NAME}`` references in reader options; a missing variable is an error."""

    def lookup(match: re.Match) -> str:
        if match[1] not in os.environ:
            raise KeyError(f"environment variable {match[1]} is not set")
        return os.environ[match[1]]

    return re.sub(r"\$\{(\w+)\}", lookup, value)
