"""The policy bundles and derived relations the registered queries work on.

Relations are stated once as column expressions that Spark SQL and DuckDB read alike.
Two bundles: a small one from a configuration, and a large one whose policy tables are
derived from the data and grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators.enforce import ResidencyKey
from palisade.sources.policy import SCHEMAS, Bundle
from palisade.sources.registry import Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def registered(sql: str | None = None):
    """Register a query under its function name, with its checking SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ── the small bundle ───────────────────────────────────────────────

_LOGIN = {"host": "localhost", "database": "d", "username": "reader", "password": "not-shown"}
# where the tables are said to live: one store for each kind of use
_STORES = {
    "people_db": ("spanner", {"project": "p", "instance": "i", "database": "people"}, {}),
    "parts_hub": ("mariadb", {"host": "localhost"}, _LOGIN),
    "warehouse": ("alloydb", {"host": "localhost"}, _LOGIN),
    "cold_store": ("bigquery", {"project": "p"}, {}),
    "feed_api": ("rest", {"url": "/landed"}, {"apiKey": "k"}),
}


def _column(name: str, classification: str, masking: str = "none", form: str | None = None) -> dict:
    return {"name": name, "classification": classification, "masking": masking} | ({"maskFormat": form} if form else {})


def _table(name: str, classification: str, *columns: dict, **rules) -> dict:
    return {"table": name, "classification": classification} | ({"columns": list(columns)} if columns else {}) | rules


# what a table holds decides its policy: people are filtered and masked, money is capped, places are open
_POLICIES = {
    "warehouse": {
        "tables": [
            _table(
                "customer", "pii",
                _column("c_name", "pii", "partial", "name-****"), _column("c_acctbal", "pci", "redact"), _column("c_mktsegment", "internal"),
                rowFilter="c_acctbal > 0",
            ),
            _table("orders", "internal", maxRows=600),
            _table("lineitem", "internal", _column("l_extendedprice", "confidential")),
            _table("nation", "public", requireApprovalForWrites=False),
            _table("region", "public"),
            _table("supplier", "confidential", _column("s_acctbal", "pci", "hash"), _column("s_name", "internal", "partial", "****")),
        ],
    },
    "parts_hub": {"defaultClassification": "public", "tables": [_table("part", "public", maxRows=25, rowFilter="p_size > 10")]},
    "people_db": {
        "defaultClassification": "restricted",
        "tables": [
            _table("customer", "pii", _column("c_name", "pii", "tokenize"), residency=["AFRICA", "ASIA", "MIDDLE EAST"]),
            _table("supplier", "restricted", _column("s_name", "restricted", "redact"), requireApprovalForWrites=False, maxRows=30),
        ],
    },
}
# (agent, highest class, sources it is held to); limits grow with the class
_CLEARED = [("steward", "pii", None), ("order-desk", "internal", ["warehouse"]), ("planner", "confidential", ["warehouse", "parts_hub"])]
_LEVEL = {"internal": 1, "confidential": 2, "pii": 4}


def _agent(agent: str, level: str, held_to: list[str] | None) -> dict:
    n = _LEVEL[level]
    out = {
        "agent": agent,
        "allowedClassifications": [level],
        "maxRowsPerQuery": 800 * n,
        "maxConcurrency": 2 + 3 * n,
        "queryTimeoutMs": 9000 * n,
    }
    if held_to:
        return out | {"allowedSources": held_to}
    return out | {"allowedOperations": ["DELETE", "INSERT", "SELECT", "UPDATE"], "requireApprovalForWrites": False}


CONFIG = {
    "sources": [{"type": t, "name": n, "connection": c, "credentials": k} for n, (t, c, k) in _STORES.items()],
    "scopes": [
        {
            "agent": "order-desk",
            "sources": [
                {
                    "name": "warehouse",
                    "rules": [
                        {
                            "table": "orders",
                            "fields": ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
                            "filters": {"o_orderstatus": "O"},
                        },
                        {"table": "lineitem", "fields": ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]},
                        {"table": "nation"},
                        {"table": "region"},
                    ],
                }
            ],
        },
        {
            "agent": "planner",
            "sources": [
                {
                    "name": "warehouse",
                    "rules": [
                        {"table": "orders", "filters": {"o_orderpriority": "1-URGENT"}},
                        {"table": "lineitem"},
                        {"table": "customer"},
                        {"table": "nation"},
                    ],
                }
            ],
        },
        {
            "agent": "steward",
            "sources": [
                {
                    "name": "warehouse",
                    "rules": [
                        {"table": "customer", "fields": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]},
                        {"table": "orders"},
                        {"table": "lineitem"},
                        {"table": "nation"},
                        {"table": "region"},
                    ],
                },
                {"name": "people_db", "rules": [{"fields": ["c_custkey", "c_name", "c_nationkey"]}]},
            ],
        },
        {
            "agent": "map-reader",
            "sources": [{"name": "warehouse", "rules": [{"table": "nation"}, {"table": "region"}]}],
        },
    ],
    "governance": {
        "sourcePolicies": [{"source": source, **policy} for source, policy in _POLICIES.items()],
        "agentPolicies": [_agent(*cleared) for cleared in _CLEARED],
    },
}


def small_bundle(spark: SparkSession) -> Bundle:
    return Bundle.from_config(spark, CONFIG)


def registry(sf_dir: str) -> Registry:
    return Registry().add_files("warehouse", sf_dir, TABLES).add_files("people_db", sf_dir, TABLES)


def home_region(spark: SparkSession, sf_dir: str) -> ResidencyKey:
    """Residency of customers: nation key to region name (25 rows at any scale)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    via = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("key"), F.col("r_name").alias("region")
    )
    return ResidencyKey("c_nationkey", via)


# The same bundle for DuckDB, written out by hand.
SMALL_SQL = {
    "known": "SELECT * FROM (VALUES ('people_db'), ('parts_hub'), ('warehouse'), ('cold_store'), ('feed_api')) t(name)",
    "rules": """SELECT * FROM (VALUES
  ('order-desk', 'warehouse', 'orders', 0, ['o_orderkey','o_orderstatus','o_orderdate','o_orderpriority'],
   [{'key': 'o_orderstatus', 'value': 'O', 'type': 'string'}]),
  ('order-desk', 'warehouse', 'lineitem', 1, ['l_orderkey','l_linenumber','l_quantity','l_shipdate'], NULL),
  ('order-desk', 'warehouse', 'nation', 2, NULL, NULL),
  ('order-desk', 'warehouse', 'region', 3, NULL, NULL),
  ('planner', 'warehouse', 'orders', 0, NULL,
   [{'key': 'o_orderpriority', 'value': '1-URGENT', 'type': 'string'}]),
  ('planner', 'warehouse', 'lineitem', 1, NULL, NULL),
  ('planner', 'warehouse', 'customer', 2, NULL, NULL),
  ('planner', 'warehouse', 'nation', 3, NULL, NULL),
  ('steward', 'warehouse', 'customer', 0, ['c_custkey','c_name','c_mktsegment','c_acctbal'], NULL),
  ('steward', 'warehouse', 'orders', 1, NULL, NULL),
  ('steward', 'warehouse', 'lineitem', 2, NULL, NULL),
  ('steward', 'warehouse', 'nation', 3, NULL, NULL),
  ('steward', 'warehouse', 'region', 4, NULL, NULL),
  ('steward', 'people_db', NULL, 0, ['c_custkey','c_name','c_nationkey'], NULL),
  ('map-reader', 'warehouse', 'nation', 0, NULL, NULL),
  ('map-reader', 'warehouse', 'region', 1, NULL, NULL)
) t(agent, source, "table", rule_pos, fields, filters)""",
    "ap": """SELECT * FROM (VALUES
  ('steward', 4, ['SELECT','INSERT','UPDATE','DELETE'], NULL, 3200, false, 14, 36000),
  ('order-desk', 1, ['SELECT'], ['warehouse'], 800, true, 5, 9000),
  ('planner', 2, ['SELECT'], ['warehouse', 'parts_hub'], 1600, true, 8, 18000)
) t(agent, rnk, ops, srcs, max_rows, approve, max_concurrency, timeout_ms)""",
    "sp": """SELECT * FROM (VALUES ('warehouse', 'internal'), ('parts_hub', 'public'), ('people_db', 'restricted'))
  t(source, default_class)""",
    "tp": """SELECT * FROM (VALUES
  ('warehouse', 'customer', 'pii', 'c_acctbal > 0', 0, true),
  ('warehouse', 'orders', 'internal', NULL, 600, true),
  ('warehouse', 'lineitem', 'internal', NULL, 0, true),
  ('warehouse', 'nation', 'public', NULL, 0, false),
  ('warehouse', 'region', 'public', NULL, 0, true),
  ('warehouse', 'supplier', 'confidential', NULL, 0, true),
  ('parts_hub', 'part', 'public', 'p_size > 10', 25, true),
  ('people_db', 'customer', 'pii', NULL, 0, true),
  ('people_db', 'supplier', 'restricted', NULL, 30, false)
) t(source, "table", classification, row_filter, max_rows, approve)""",
    "cp": """SELECT * FROM (VALUES
  ('warehouse', 'customer', 0, 'c_name', 'pii', 'partial', 'name-****'),
  ('warehouse', 'customer', 1, 'c_acctbal', 'pci', 'redact', NULL),
  ('warehouse', 'customer', 2, 'c_mktsegment', 'internal', 'none', NULL),
  ('warehouse', 'lineitem', 0, 'l_extendedprice', 'confidential', 'none', NULL),
  ('warehouse', 'supplier', 0, 's_acctbal', 'pci', 'hash', NULL),
  ('warehouse', 'supplier', 1, 's_name', 'internal', 'partial', '****'),
  ('people_db', 'customer', 0, 'c_name', 'pii', 'tokenize', NULL),
  ('people_db', 'supplier', 0, 's_name', 'restricted', 'redact', NULL)
) t(source, "table", pos, name, classification, masking, mask_format)""",
}

# ── requests from the event stream, for the small bundle ───────────

_TARGET = (
    "CASE event_id % 7 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem' WHEN 3 THEN 'nation'"
    " WHEN 4 THEN 'region' WHEN 5 THEN 'supplier' ELSE 'part' END"
)
REQUEST_COLUMNS = {
    "request_id": "event_id",
    "ts": "ts",
    "agent": "CASE WHEN value > 60 THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'order-desk'"
    " WHEN 1 THEN 'planner' WHEN 2 THEN 'steward' WHEN 3 THEN 'map-reader' ELSE 'visitor' END END",
    "source": "CASE event_id % 8 WHEN 5 THEN 'people_db' WHEN 6 THEN 'feed_api' WHEN 7 THEN 'attic_db'"
    " ELSE 'warehouse' END",
    "query": f"CASE WHEN event_id % 11 = 0 THEN '' WHEN event_type = 'click'"
    f" THEN 'SELECT c_name, t.c_acctbal, c_custkey AS id FROM ' || {_TARGET} || ' WHERE id = 1'"
    f" WHEN event_type = 'view' THEN 'select  *  from ' || {_TARGET}"
    f" WHEN event_type = 'signup' THEN 'INSERT INTO x SELECT c_name, c_custkey FROM ' || {_TARGET}"
    f" WHEN event_type = 'purchase' THEN 'UPDATE ' || {_TARGET} || ' SET c_name = 1'"
    f" ELSE '  delete from ' || {_TARGET} || ' where c_name = 1' END",
}
# the same log with the text already taken apart
DECISION_COLUMNS = {
    "request_id": "event_id",
    "agent": "CASE user_id % 5 WHEN 0 THEN 'order-desk' WHEN 1 THEN 'planner' WHEN 2 THEN 'steward'"
    " WHEN 3 THEN 'map-reader' ELSE 'visitor' END",
    "source": REQUEST_COLUMNS["source"],
    "table": _TARGET,
    "operation": "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'"
    " ELSE 'SELECT' END",
    "columns": "CASE event_id % 3 WHEN 0 THEN split('c_acctbal,c_custkey,c_name', ',') WHEN 1"
    " THEN split('C_NAME', ',') ELSE split('o_orderkey,c_mktsegment', ',') END",
}
AUDIT_COLUMNS = {
    "seq": "event_id",
    "timestamp": "ts",
    "agent_id": DECISION_COLUMNS["agent"],
    "source": REQUEST_COLUMNS["source"],
    "action": "CASE WHEN event_id % 2 = 0 THEN 'QUERY' ELSE 'BATCH_QUERY' END",
    "resource": _TARGET,
    "row_count": "CASE WHEN value >= 5 THEN CAST(round(value) AS bigint) END",
    "policy_decision": "CASE WHEN value >= 5 THEN 'permitted' ELSE 'denied' END",
    "duration_ms": "CASE WHEN value >= 5 THEN CAST(round(value * 1000) AS bigint) END",
}


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def project_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{text} AS "{name}"' for name, text in columns.items()) + f" FROM {source}"


def requests(spark, sf_dir) -> DataFrame:
    return project(table(spark, sf_dir, "events"), REQUEST_COLUMNS)


def parsed_requests(spark, sf_dir) -> DataFrame:
    return project(table(spark, sf_dir, "events"), DECISION_COLUMNS)


def audit(spark, sf_dir) -> DataFrame:
    return project(table(spark, sf_dir, "events"), AUDIT_COLUMNS)


# ── the large bundle: policies that grow with the data ─────────────

BIG = {
    "sources": (
        "supplier",
        {
            "pos": "s_suppkey",
            "name": "'src-' || CAST(s_suppkey AS string)",
            "type": "CASE s_nationkey % 9 WHEN 0 THEN 'rest' WHEN 1 THEN 'postgres' WHEN 2 THEN 'mysql'"
            " WHEN 3 THEN 'mariadb' WHEN 4 THEN 'bigquery' WHEN 5 THEN 'spanner' WHEN 6 THEN 'alloydb'"
            " WHEN 7 THEN 'cloud-sql-mysql' ELSE 'cloud-sql-postgres' END",
        },
    ),
    "source_policy": (
        "supplier",
        {
            "source_pos": "s_suppkey",
            "source": "'src-' || CAST(s_suppkey AS string)",
            "default_class": "CASE s_nationkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal'"
            " WHEN 2 THEN 'restricted' ELSE 'pii' END",
        },
    ),
    "table_policy": (
        "part",
        {
            "source_pos": "CAST(p_size AS bigint)",
            "table_pos": "p_partkey",
            "source": "'src-' || CAST(p_size AS string)",
            "table": "p_type",
            "classification": "CASE p_partkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal'"
            " WHEN 2 THEN 'confidential' WHEN 3 THEN 'pii' ELSE 'pci' END",
            "row_filter": "CASE WHEN p_partkey % 2 = 0 THEN 'size > ' || CAST(p_size AS string) END",
            "max_rows": "(p_partkey % 7) * 100",
            "approve_writes": "p_partkey % 3 = 0",
        },
    ),
    "column_policy": (
        "part",
        {
            "source_pos": "CAST(p_size AS bigint)",
            "table_pos": "p_partkey",
            "pos": "p_partkey % 10",
            "source": "'src-' || CAST(p_size AS string)",
            "table": "p_type",
            "name": "'col_' || CAST(p_partkey % 4 AS string)",
            "classification": "CASE p_partkey % 2 WHEN 0 THEN 'pii' ELSE 'internal' END",
            "masking": "CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'hash' ELSE 'partial' END",
            "mask_format": "CASE WHEN p_partkey % 6 = 2 THEN '**-**' END",
        },
    ),
    "agent_policy": (
        "customer",
        {
            "pos": "c_custkey",
            "agent": "'agent-' || CAST(c_custkey AS string)",
            "allowed_classes": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN split('public', ',')"
            " WHEN 'BUILDING' THEN split('public,internal', ',') WHEN 'FURNITURE' THEN split('confidential,public', ',')"
            " WHEN 'HOUSEHOLD' THEN split('pii', ',') ELSE split('pci,internal', ',') END",
            "max_rows": "CAST(c_nationkey AS bigint) * 20",
            "max_concurrency": "CAST(1 + c_nationkey % 5 AS bigint)",
            "timeout_ms": "CAST(1000 * (1 + c_nationkey) AS bigint)",
            "allowed_ops": "CASE WHEN c_acctbal < 1000 THEN split('SELECT', ',') WHEN c_acctbal < 5000"
            " THEN split('SELECT,INSERT', ',') ELSE split('SELECT,INSERT,UPDATE,DELETE', ',') END",
            "approve_writes": "CASE WHEN c_nationkey % 3 = 0 THEN true WHEN c_nationkey % 3 = 1 THEN false END",
            "allowed_sources": "CASE WHEN c_nationkey % 4 = 0 THEN split('src-1,src-2,src-3,src-5,src-8,src-13', ',')"
            " END",
        },
    ),
    "scope_rules": (
        "orders",
        {
            "scope_pos": "o_custkey * 2 + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END",
            "source_pos": "(o_orderkey % 50) * 2 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
            "rule_pos": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey END",
            "agent": "'agent-' || CAST(o_custkey AS string)",
            "source": "'src-' || CAST(o_orderkey % 50 AS string)",
            "table": "CASE o_orderpriority WHEN '1-URGENT' THEN 'SMALL' WHEN '2-HIGH' THEN 'LARGE'"
            " WHEN '3-MEDIUM' THEN 'ECONOMY' WHEN '5-LOW' THEN 'PROMO' END",
            "fields": "CASE o_orderstatus WHEN 'F' THEN split('col_2,col_0', ',')"
            " WHEN 'O' THEN split('id,col_1,col_2', ',') END",
        },
    ),
}
# filters of the large rules: one list per engine
_BIG_FILTERS_SPARK = (
    "CASE WHEN o_totalprice > 250000 THEN array(named_struct('key', 'status', 'value', o_orderstatus,"
    " 'type', 'string'), named_struct('key', 'year', 'value', CAST(year(o_orderdate) AS string), 'type', 'number'))"
    " WHEN o_totalprice < 20000 THEN array(named_struct('key', 'year', 'value', '0', 'type', 'number')) END"
)
_BIG_FILTERS_DUCK = (
    "CASE WHEN o_totalprice > 250000 THEN [{'key': 'status', 'value': o_orderstatus, 'type': 'string'},"
    " {'key': 'year', 'value': CAST(year(o_orderdate) AS string), 'type': 'number'}]"
    " WHEN o_totalprice < 20000 THEN [{'key': 'year', 'value': '0', 'type': 'number'}] END"
)
# requests of the large bundle, joined from line items and their orders
BIG_REQUEST_COLUMNS = {
    "request_id": "l_orderkey * 10 + l_linenumber",
    "agent": "'agent-' || CAST(o_custkey AS string)",
    "source": "'src-' || CAST(CASE WHEN l_linenumber < 5 THEN o_orderkey % 50 ELSE l_suppkey END AS string)",
    "table": "CASE WHEN l_linenumber < 4 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'SMALL'"
    " WHEN '2-HIGH' THEN 'LARGE' WHEN '3-MEDIUM' THEN 'ECONOMY' ELSE 'PROMO' END ELSE 'STANDARD' END",
    "operation": "CASE l_returnflag WHEN 'R' THEN 'INSERT' WHEN 'A' THEN 'SELECT'"
    " ELSE CASE l_linestatus WHEN 'O' THEN 'DELETE' ELSE 'SELECT' END END",
    "columns": "CASE l_linenumber % 3 WHEN 0 THEN split('COL_2,col_1', ',') WHEN 1 THEN split('id,col_0,col_1', ',')"
    " ELSE split('id', ',') END",
}


def big_bundle(spark, sf_dir) -> Bundle:
    """Policy tables of unknown size: joins get no broadcast hint."""
    tables = {}
    for name, (source, columns) in BIG.items():
        raw = table(spark, sf_dir, source)
        if name == "scope_rules":
            columns = columns | {"filters": _BIG_FILTERS_SPARK}
        shaped = project(raw, columns)
        tables[name] = shaped.select(
            *[
                (F.col(f.name) if f.name in shaped.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SCHEMAS[name].fields
            ]
        )
    return Bundle.from_tables(spark, **tables)


def big_requests(spark, sf_dir) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return project(lines.join(orders, lines.l_orderkey == orders.o_orderkey), BIG_REQUEST_COLUMNS)


_RANK_LIST = "['public','internal','confidential','restricted','pii','phi','pci']"


def rank_sql(expr: str) -> str:
    return f"(greatest(coalesce(list_position({_RANK_LIST}, {expr}), 0), 1) - 1)"


def _big_sql(name: str) -> str:
    source, columns = BIG[name]
    if name == "scope_rules":
        columns = columns | {"filters": _BIG_FILTERS_DUCK}
    return project_sql(columns, source)


BIG_SQL = {
    "known": f"SELECT DISTINCT name FROM ({_big_sql('sources')})",
    "all_rules": _big_sql("scope_rules"),
    "scoped": "SELECT agent, min(scope_pos) AS scope_pos FROM all_rules GROUP BY agent",
    "entered": "SELECT agent, source, min(source_pos) AS source_pos FROM all_rules JOIN scoped USING (agent, scope_pos)"
    " GROUP BY agent, source",
    "rules": "SELECT r.* FROM all_rules r JOIN scoped USING (agent, scope_pos)"
    " JOIN entered USING (agent, source, source_pos)",
    "ap": f"""SELECT agent, coalesce(list_max(list_transform(allowed_classes, lambda c: {rank_sql('c')})), -1) AS rnk,
  allowed_ops AS ops, allowed_sources AS srcs, max_rows, approve_writes AS approve, max_concurrency, timeout_ms
  FROM ({_big_sql('agent_policy')})""",
    "sp": f"SELECT source, default_class FROM ({_big_sql('source_policy')})",
    "tp_all": f"SELECT *, row_number() OVER (PARTITION BY source, \"table\" ORDER BY table_pos) AS rn"
    f" FROM ({_big_sql('table_policy')}) WHERE source IN (SELECT source FROM sp)",
    "tp": "SELECT source, \"table\", classification, row_filter, max_rows, approve_writes AS approve, table_pos"
    " FROM tp_all WHERE rn = 1",
    "cp": f"SELECT c.* FROM ({_big_sql('column_policy')}) c JOIN tp USING (source, \"table\", table_pos)",
}

# ── shared SQL of the checks ───────────────────────────────────────


def with_sql(parts: dict[str, str], select: str) -> str:
    """One WITH query from named parts."""
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items()) + "\n" + select


REQUESTS_SQL = {"reqs": project_sql(DECISION_COLUMNS, "events")}
BIG_REQUESTS_SQL = {
    "reqs": project_sql(BIG_REQUEST_COLUMNS, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
}
TEXT_REQUESTS_SQL = {"logged": project_sql(REQUEST_COLUMNS, "events")}
AUDIT_SQL = {"audit": project_sql(AUDIT_COLUMNS, "events")}

# decisions for reqs(agent, source, "table", operation, "columns"); agents without policy
# get rank 0, SELECT only, 100 rows and the approval flag
DECIDED = {
    "shown": """SELECT source, "table", list({'p': pos, 'n': name, 's': masking, 'f': mask_format}
  ORDER BY pos, name, masking, mask_format NULLS FIRST) AS masks FROM cp WHERE masking <> 'none' GROUP BY ALL""",
    "looked": f"""SELECT r.*, a.agent IS NOT NULL AS has_policy,
  CASE WHEN a.agent IS NULL THEN 0 ELSE a.rnk END AS rnk,
  CASE WHEN a.agent IS NULL THEN ['SELECT'] ELSE a.ops END AS ops, a.srcs,
  CASE WHEN a.agent IS NULL THEN 100 ELSE a.max_rows END AS agent_cap,
  CASE WHEN a.agent IS NULL THEN true ELSE coalesce(a.approve, false) END AS agent_approve,
  coalesce(t.classification, s.default_class, 'internal') AS cls,
  t.row_filter AS table_filter, coalesce(t.max_rows, 0) AS table_cap, coalesce(t.approve, true) AS table_approve,
  m.masks
  FROM reqs r LEFT JOIN ap a USING (agent) LEFT JOIN sp s ON s.source = r.source
  LEFT JOIN tp t ON t.source = r.source AND t."table" = r."table"
  LEFT JOIN shown m ON m.source = r.source AND m."table" = r."table\"""",
    "tested": f"""SELECT *, coalesce(list_contains(ops, operation), false) AS op_ok,
  srcs IS NULL OR len(srcs) = 0 OR list_contains(srcs, source) AS src_ok,
  {rank_sql('cls')} <= rnk AS cls_ok FROM looked""",
    "dec": """SELECT *, op_ok AND src_ok AND cls_ok AS allowed,
  CASE WHEN NOT op_ok THEN 'Agent ' || agent || ' is not allowed to perform ' || operation || ' operations'
       WHEN NOT src_ok THEN 'Agent ' || agent || ' is not allowed to access source: ' || source
       WHEN NOT cls_ok THEN 'Agent ' || agent || ' cannot access ' || cls || '-classified data in ' || source || '.' ||
         "table" END AS why,
  CASE WHEN op_ok AND src_ok AND cls_ok THEN array_to_string(list_transform(list_filter(masks, lambda m:
    list_contains(list_transform("columns", lambda c: lower(c)), lower(m.n))), lambda m: concat_ws(':', m.n, m.s, m.f)),
    ',') END AS masked,
  CASE WHEN op_ok AND src_ok AND cls_ok THEN table_filter END AS row_filter,
  CASE WHEN NOT (op_ok AND src_ok AND cls_ok) THEN 0 WHEN table_cap > 0 AND agent_cap > 0
    THEN least(table_cap, agent_cap) ELSE greatest(table_cap, agent_cap) END AS max_rows,
  op_ok AND src_ok AND cls_ok AND operation IN ('INSERT','UPDATE','DELETE') AND (agent_approve OR table_approve)
    AS requires_approval FROM tested""",
}
DECISION_SELECT = """SELECT request_id, allowed, why AS reason, nullif(masked, '') AS masked, row_filter,
  CAST(max_rows AS BIGINT) AS max_rows, requires_approval FROM dec"""

# scope decisions for reqs(agent, source, "table")
SCOPED = {
    "pairs": 'SELECT DISTINCT agent, source, "table" FROM reqs',
    "hits": """SELECT p.agent, p.source, p."table", r.rule_pos, r.fields, r.filters FROM pairs p JOIN rules r
  ON r.agent = p.agent AND r.source = p.source AND (r."table" IS NULL OR r."table" = p."table")
  WHERE r.rule_pos IS NOT NULL""",
    "f1": """SELECT agent, source, "table", rule_pos, unnest(fields) AS f, generate_subscripts(fields, 1) AS i FROM hits
  WHERE fields IS NOT NULL""",
    "f2": 'SELECT agent, source, "table", f, min((rule_pos, i)) AS place FROM f1 GROUP BY ALL',
    "f3": """SELECT agent, source, "table", string_agg(f, ',' ORDER BY place) AS fields FROM f2 GROUP BY ALL""",
    "g1": """SELECT agent, source, "table", rule_pos, unnest(filters) AS f, generate_subscripts(filters, 1) AS i
  FROM hits WHERE filters IS NOT NULL""",
    "g2": """SELECT agent, source, "table", f.key AS k, min((rule_pos, i)) AS place,
  arg_max(f.value || ':' || f.type, (rule_pos, i)) AS v FROM g1 GROUP BY ALL""",
    "g3": """SELECT agent, source, "table", string_agg(k || '=' || v, ',' ORDER BY place) AS filters FROM g2 GROUP BY ALL""",
    "sco": """SELECT r.*, h.agent IS NOT NULL AS permitted,
  CASE WHEN r.agent NOT IN (SELECT agent FROM rules) THEN 'No scope defined for agent: ' || r.agent
       WHEN (r.agent, r.source) NOT IN (SELECT (agent, source) FROM rules)
         THEN 'Agent ' || r.agent || ' has no access to source: ' || r.source
       WHEN h.agent IS NULL THEN 'Table ' || r."table" || ' not in scope for agent ' || r.agent END AS scope_why,
  f3.fields, g3.filters
  FROM reqs r
  LEFT JOIN (SELECT DISTINCT agent, source, "table" FROM hits) h
    ON h.agent = r.agent AND h.source = r.source AND h."table" = r."table"
  LEFT JOIN f3 ON f3.agent = r.agent AND f3.source = r.source AND f3."table" = r."table"
  LEFT JOIN g3 ON g3.agent = r.agent AND g3.source = r.source AND g3."table" = r."table\"""",
}

# ── flat forms of nested results ───────────────────────────────────


def flat_masks(c) -> Column:
    return F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["name"], m["strategy"], m["format"])), ",")


def flat_filters(c) -> Column:
    return F.array_join(F.transform(c, lambda f: F.concat(f["key"], F.lit("="), f["value"], F.lit(":"), f["type"])), ",")


def flat_decision(df: DataFrame) -> DataFrame:
    d = "decision."
    return df.select(
        "request_id",
        d + "allowed",
        d + "reason",
        flat_masks(F.col(d + "masked_columns")).alias("masked"),
        d + "row_filter",
        d + "max_rows",
        d + "requires_approval",
    )


def flat_scope(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "scope.permitted",
        "scope.reason",
        F.array_join("scope.fields", ",").alias("fields"),
        flat_filters(F.col("scope.filters")).alias("filters"),
    )
