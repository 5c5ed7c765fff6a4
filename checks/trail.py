"""Audit analytics, policy maintenance, view catalog, sources and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.relations import (
    AUDIT_COLUMNS,
    AUDIT_SQL,
    BIG_SQL,
    DECIDED,
    ORACLES,
    REQUEST_COLUMNS,
    SCOPED,
    SMALL_SQL,
    TEXT_REQUESTS_SQL,
    audit,
    big_bundle,
    project,
    project_sql,
    registered,
    registry,
    requests,
    small_bundle,
    table,
    with_sql,
)
from checks.verdicts import _ALL_READABLE, _NONE_GRANTED, _OUTCOMES
from palisade.operators import audit as trail, enforce, maintenance, viewcatalog
from palisade.session import fresh_path, materialise
from palisade.sources import audit_log, readers
from palisade.streaming import streams

_AUDIT_COLS = ", ".join(f'"{c}"' for c in AUDIT_COLUMNS)

# ── audit ──────────────────────────────────────────────────────────


@registered(with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit"))
def audit_round_trip(spark, sf_dir):
    """Append the trail as JSON lines in two writes and read it back."""
    entries, path = audit(spark, sf_dir), fresh_path(spark, "audit")
    audit_log.append_audit(entries.filter("policy_decision = 'permitted'"), path)
    audit_log.append_audit(entries.filter("policy_decision = 'denied'"), path)
    return audit_log.read_audit(spark, path)


@registered(
    "SELECT 'steward' AS agent_id, 'customer' AS resource, least(3200, count(*)) AS row_count, 'permitted' AS"
    " policy_decision FROM customer WHERE c_acctbal > 0"
)
def audit_of_run(spark, sf_dir):
    """Run a governed query into a table and read the audit record it left."""
    path = fresh_path(spark, "audit")
    result = enforce.governed_table(
        spark, registry(sf_dir), small_bundle(spark), "steward", "warehouse", "customer"
    )
    trail.run_audited(result, lambda df: df.write.parquet(fresh_path(spark, "rows")), path)
    return audit_log.read_audit(spark, path).select("agent_id", "resource", "row_count", "policy_decision")


@registered(with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit ORDER BY seq DESC LIMIT 20"))
def audit_view(spark, sf_dir):
    return trail.view_audit(audit(spark, sf_dir))


@registered(
    with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit WHERE agent_id = 'steward' ORDER BY seq DESC LIMIT 50")
)
def audit_view_of_agent(spark, sf_dir):
    return trail.view_audit(audit(spark, sf_dir), "steward", 50)


_MIXED = AUDIT_COLUMNS | {"seq": "CASE WHEN event_id % 2 = 0 THEN event_id + 1700000000000000 ELSE event_id END"}


@registered(f"SELECT {_AUDIT_COLS} FROM ({project_sql(_MIXED, 'events')}) ORDER BY timestamp DESC, seq DESC LIMIT 45")
def audit_view_mixed(spark, sf_dir):
    """A trail of live entries, numbered by the clock, and of judged logs, numbered by request: newest first all the same."""
    path, entries = fresh_path(spark, "audit"), project(table(spark, sf_dir, "events"), _MIXED)
    for part in ("seq < 1700000000000000", "seq >= 1700000000000000"):
        audit_log.append_audit(entries.filter(part), path)
    return trail.view_audit(audit_log.read_audit(spark, path), limit=45)


@registered(with_sql(AUDIT_SQL, "SELECT count(*) AS total FROM audit"))
def audit_total(spark, sf_dir):
    return trail.audit_total(audit(spark, sf_dir))


@registered(
    with_sql(
        BIG_SQL,
        "SELECT (SELECT count(*) FROM supplier) AS source_count, (SELECT count(DISTINCT (agent, scope_pos)) FROM"
        " all_rules) AS scope_count, (SELECT count(*) FROM events) AS entry_count",
    )
)
def health_counts(spark, sf_dir):
    return trail.health_counts(big_bundle(spark, sf_dir), audit(spark, sf_dir))


_USAGE = """count(*) AS requests, count(*) FILTER (policy_decision = 'denied') AS denials,
CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms,
max(duration_ms) AS max_ms"""


@registered(
    with_sql(AUDIT_SQL, f"SELECT agent_id, source, resource, {_USAGE} FROM audit GROUP BY agent_id, source, resource")
)
def access_summary(spark, sf_dir):
    return trail.access_summary(audit(spark, sf_dir))


def _grouped_sql(kind: str) -> str:
    return with_sql(
        AUDIT_SQL,
        f"SELECT agent_id, source, resource, CAST(grouping(agent_id, source, resource) AS BIGINT) AS level, {_USAGE}"
        f" FROM audit GROUP BY {kind} (agent_id, source, resource)",
    )


@registered(_grouped_sql("ROLLUP"))
def access_rollup(spark, sf_dir):
    return trail.access_rollup(audit(spark, sf_dir))


@registered(_grouped_sql("CUBE"))
def access_cube(spark, sf_dir):
    return trail.access_cube(audit(spark, sf_dir))


_AS_OF = "2024-01-20 12:00:00"


@registered(
    with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit WHERE timestamp >= TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY")
)
def retention_kept(spark, sf_dir):
    return trail.retained(audit(spark, sf_dir), F.lit(_AS_OF).cast("timestamp_ntz"), 7)


@registered(
    with_sql(
        AUDIT_SQL,
        f"""SELECT seq, CASE WHEN seq % 11 <> 0 AND timestamp < TIMESTAMP '{_AS_OF}' THEN 'archived' ELSE 'kept' END AS at,
seq % 11 <> 0 AND timestamp >= TIMESTAMP '2024-01-18 20:00:00' AND timestamp < TIMESTAMP '2024-01-22 01:00:00' AS in_span FROM audit""",
    )
)
def audit_trail_by_day(spark, sf_dir):
    """A trail of day files from a batch and a stream's batch: small files put together, old entries moved to an archive."""
    entries = audit(spark, sf_dir).withColumn("timestamp", F.when(F.col("seq") % 11 != 0, F.col("timestamp")))
    kept, gone = (audit_log.AuditTrail.open(spark, fresh_path(spark, name)) for name in ("trail", "archive"))
    kept.append(entries.filter("seq % 2 = 0"))
    for _ in range(2):  # the second time nothing happens
        kept.append(entries.filter("seq % 2 = 1"), "live", 0)
    kept.compact(1 << 20)
    span = kept.read_span(datetime(2024, 1, 18, 20), datetime(2024, 1, 22, 1)).select("seq", F.lit(True).alias("in_span"))
    kept.retain(datetime.fromisoformat(_AS_OF), gone)
    rows = kept.read().select("seq", F.lit("kept").alias("at")).unionByName(gone.read().select("seq", F.lit("archived").alias("at")))
    return rows.join(span, "seq", "left").select("seq", "at", F.coalesce("in_span", F.lit(False)).alias("in_span"))


@registered(
    with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit WHERE timestamp < TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY")
)
def retention_expired(spark, sf_dir):
    return trail.expired(audit(spark, sf_dir), F.lit(_AS_OF).cast("timestamp_ntz"), 7)


@registered(
    with_sql(
        AUDIT_SQL,
        f"""SELECT seq, seq % 5 <> 0 AND timestamp < TIMESTAMP '{_AS_OF}' - INTERVAL 365 DAY + INTERVAL 350 DAY AS gone
FROM audit""",
    )
)
def retention_split(spark, sf_dir):
    """Kept and expired entries by the days the policies set; entries without a time are kept."""
    timed = audit(spark, sf_dir).withColumn("timestamp", F.when(F.col("seq") % 5 != 0, F.col("timestamp")))
    as_of = F.lit(_AS_OF).cast("timestamp_ntz") + F.make_dt_interval(F.lit(350))
    kept, gone = trail.retention_split(timed, small_bundle(spark), as_of)
    return kept.select("seq", F.lit(False).alias("gone")).unionByName(gone.select("seq", F.lit(True).alias("gone")))


_LIMITS = SMALL_SQL["ap"]


@registered(
    with_sql(
        AUDIT_SQL | {"ap": _LIMITS},
        """SELECT seq, agent_id, duration_ms, CAST(coalesce(timeout_ms, 10000) AS BIGINT) AS timeout_ms FROM audit
LEFT JOIN ap ON agent = agent_id WHERE duration_ms > coalesce(timeout_ms, 10000)""",
    )
)
def timeout_breaches(spark, sf_dir):
    return trail.timeout_breaches(audit(spark, sf_dir), small_bundle(spark))


@registered(
    with_sql(
        AUDIT_SQL
        | {
            "ap": _LIMITS,
            "steps": """SELECT agent_id, timestamp AS t, 1 AS step FROM audit WHERE duration_ms > 0 UNION ALL
SELECT agent_id, timestamp + to_milliseconds(duration_ms), -1 FROM audit WHERE duration_ms > 0""",
            "levels": """SELECT agent_id, sum(step) OVER (PARTITION BY agent_id ORDER BY t, step ROWS UNBOUNDED PRECEDING)
AS lvl FROM steps""",
            "peaks": "SELECT agent_id, CAST(max(lvl) AS BIGINT) AS peak FROM levels GROUP BY agent_id",
        },
        """SELECT agent_id, peak, CAST(coalesce(max_concurrency, 1) AS BIGINT) AS max_concurrency,
peak > coalesce(max_concurrency, 1) AS breached FROM peaks LEFT JOIN ap ON agent = agent_id""",
    )
)
def peak_concurrency(spark, sf_dir):
    return trail.peak_concurrency(audit(spark, sf_dir), small_bundle(spark))


@registered(
    with_sql(
        AUDIT_SQL,
        """SELECT agent_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, count(*) AS requests FROM audit
GROUP BY ALL HAVING count(*) > 3""",
    )
)
def rate_limit(spark, sf_dir):
    return trail.rate_limit_breaches(audit(spark, sf_dir), 3, "1 hour")


@registered(
    with_sql(
        AUDIT_SQL
        | {
            "ranked": "SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY timestamp, seq) AS rn FROM audit",
            "reached": "SELECT agent_id, timestamp, max(rn) AS upto FROM ranked GROUP BY ALL",
            "counted": """SELECT r.seq, r.agent_id, r.timestamp, r.rn - coalesce(b.upto, 0) AS in_window FROM ranked r
ASOF LEFT JOIN reached b ON r.agent_id = b.agent_id AND r.timestamp - INTERVAL 1 DAY >= b.timestamp""",
        },
        "SELECT seq, agent_id, timestamp, CAST(in_window AS BIGINT) AS in_window FROM counted WHERE in_window > 5",
    )
)
def sliding_limit(spark, sf_dir):
    """Entries with which an agent had over five requests in the day that ended with them."""
    return trail.sliding_limit_breaches(audit(spark, sf_dir), 5, "1 day")


@registered(
    with_sql(
        AUDIT_SQL,
        """SELECT agent_id, count(*) AS requests, count(DISTINCT resource) AS resources, true AS median_near, true AS tail_near
FROM audit GROUP BY agent_id""",
    )
)
def usage_from_sketches(spark, sf_dir):
    """Totals of each agent out of stored hourly sketches; their quantiles' true ranks are near the ones asked for."""
    entries = audit(spark, sf_dir)
    sketches = materialise(trail.usage_sketches(entries), "sketches")
    found = trail.usage_of_sketches(sketches, "agent_id", ranks=(0.5, 0.9))
    below = lambda q: F.sum((F.col("duration_ms") < F.col(q)).cast("int")) / F.count("duration_ms")
    upto = lambda q: F.sum((F.col("duration_ms") <= F.col(q)).cast("int")) / F.count("duration_ms")
    near = lambda q, rank: (below(q) <= rank + 0.03) & (upto(q) >= rank - 0.03)
    true = entries.join(found, "agent_id").groupBy("agent_id").agg(near("ms_p50", 0.5).alias("median_near"), near("ms_p90", 0.9).alias("tail_near"))
    return found.select("agent_id", "requests", "resources").join(true, "agent_id")


@registered(
    with_sql(
        AUDIT_SQL
        | {
            "ap": _LIMITS,
            "used": """SELECT seq, agent_id, date_trunc('day', timestamp) AS window_start, row_count, CAST(sum(row_count)
OVER (PARTITION BY agent_id, date_trunc('day', timestamp) ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS BIGINT)
AS rows_so_far FROM audit WHERE row_count IS NOT NULL""",
        },
        """SELECT seq, agent_id, window_start, row_count, rows_so_far, CAST(coalesce(max_rows, 100) AS BIGINT) AS max_rows
FROM used LEFT JOIN ap ON agent = agent_id WHERE rows_so_far > coalesce(max_rows, 100)""",
    )
)
def row_quota(spark, sf_dir):
    return trail.row_quota(audit(spark, sf_dir), small_bundle(spark), "1 day")


# ── policy maintenance, over policy tables that grow with the data ─

_NEW_SCOPES = {
    "scope_pos": "c_custkey",
    "source_pos": "CAST(0 AS bigint)",
    "rule_pos": "CAST(0 AS bigint)",
    "agent": "CASE WHEN c_nationkey < 10 THEN 'agent-' || CAST(c_custkey AS string) ELSE 'new-' ||"
    " CAST(c_custkey AS string) END",
    "source": "'src-new'",
    "table": "c_mktsegment",
}


def _rules_out(df):
    return df.select("scope_pos", "agent", "source", "rule_pos", "table", F.array_join("fields", ",").alias("fields"))


_RULES_SELECT = "scope_pos, agent, source, rule_pos, \"table\", array_to_string(fields, ',') AS fields"


@registered(
    with_sql(
        BIG_SQL
        | {
            "chg": project_sql(_NEW_SCOPES, "customer"),
            "olds": "SELECT agent, min(scope_pos) AS old FROM all_rules GROUP BY agent",
            "fin": "SELECT max(scope_pos) AS e FROM all_rules",
        },
        f"""SELECT {_RULES_SELECT} FROM all_rules r WHERE agent NOT IN (SELECT agent FROM chg) OR
scope_pos > (SELECT old FROM olds o WHERE o.agent = r.agent)
UNION ALL SELECT coalesce(old, e + 1 + c.scope_pos), c.agent, source, rule_pos, "table", NULL FROM chg c
LEFT JOIN olds USING (agent) CROSS JOIN fin""",
    ).replace(
        f"OR\nscope_pos > (SELECT old FROM olds o WHERE o.agent = r.agent)",
        "OR scope_pos > (SELECT old FROM olds o WHERE o.agent = r.agent)",
    )
)
def scope_upsert(spark, sf_dir):
    bundle = big_bundle(spark, sf_dir)
    changes = project(table(spark, sf_dir, "customer"), _NEW_SCOPES)
    changes = changes.withColumns(
        {"fields": F.lit(None).cast("array<string>"), "filters": F.lit(None).cast(bundle.scope_rules.schema["filters"].dataType)}
    )
    return _rules_out(maintenance.upsert_scopes(bundle.scope_rules, changes))


@registered(
    with_sql(
        BIG_SQL
        | {
            "gone": "SELECT 'agent-' || CAST(c_custkey AS VARCHAR) AS agent FROM customer WHERE c_nationkey = 3",
            "firsts": "SELECT agent, min(scope_pos) AS p FROM all_rules GROUP BY agent",
        },
        f"""SELECT {_RULES_SELECT} FROM all_rules JOIN firsts USING (agent)
WHERE agent NOT IN (SELECT agent FROM gone) OR scope_pos > p""",
    )
)
def scope_remove(spark, sf_dir):
    """Removing an agent's scope lets a later one for the same agent come into force."""
    gone = table(spark, sf_dir, "customer").filter("c_nationkey = 3")
    agents = gone.select(F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("agent"))
    return _rules_out(maintenance.remove_scopes(big_bundle(spark, sf_dir).scope_rules, agents))


def _new_sources(spark, sf_dir, bundle):
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 100000).alias("pos"),
        F.concat(F.lit("src-"), (F.col("p_partkey") % 500).cast("string")).alias("name"),
        F.lit("postgres").alias("type"),
    )
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in bundle.sources.schema.fields
        ]
    )


@registered(
    with_sql(
        {
            "old": project_sql({"pos": "s_suppkey", "name": "'src-' || CAST(s_suppkey AS string)"}, "supplier"),
            "offered": "SELECT p_partkey + 100000 AS pos, 'src-' || CAST(p_partkey % 500 AS VARCHAR) AS name FROM part",
            "judged": """SELECT *, name NOT IN (SELECT name FROM old) AND
pos = min(pos) OVER (PARTITION BY name) AS ok FROM offered""",
        },
        """SELECT pos, name, true AS accepted FROM old UNION ALL SELECT pos, name, ok FROM judged""",
    )
)
def source_add(spark, sf_dir):
    """New sources; taken and repeated names are rejected before anything is stored."""
    bundle = big_bundle(spark, sf_dir)
    after, rejected = maintenance.add_sources(bundle.sources, _new_sources(spark, sf_dir, bundle))
    shown = after.select("pos", "name", F.lit(True).alias("accepted"))
    return shown.unionByName(rejected.select("pos", "name", F.lit(False).alias("accepted")))


@registered(
    "SELECT s_suppkey AS pos, 'src-' || s_suppkey AS name FROM supplier WHERE s_suppkey NOT IN (SELECT"
    " CAST(p_size AS BIGINT) FROM part WHERE p_type = 'PROMO')"
)
def source_remove(spark, sf_dir):
    promo = table(spark, sf_dir, "part").filter("p_type = 'PROMO'")
    names = promo.select(F.concat(F.lit("src-"), F.col("p_size").cast("string")).alias("name"))
    return maintenance.remove_sources(big_bundle(spark, sf_dir).sources, names).select("pos", "name")


@registered(
    """SELECT 'sources' AS policy_table, '' AS key, 'name' AS path, 'Required' AS message, count(*) AS n FROM supplier
WHERE s_nationkey = 3 GROUP BY ALL
UNION ALL SELECT 'sources', 'src-' || s_suppkey, 'type', 'Invalid source type', count(*) FROM supplier
WHERE s_nationkey = 4 GROUP BY ALL
UNION ALL SELECT 'scope_rules', '.src-' || CAST(o_orderkey % 50 AS VARCHAR), 'agent', 'Agent ID must not be empty',
count(*) FROM orders WHERE o_totalprice < 20000 GROUP BY ALL
UNION ALL SELECT 'table_policy', 'src-' || p_size || '.' || p_type, 'classification', 'Invalid classification',
count(*) FROM part WHERE p_brand = 'Brand#7' GROUP BY ALL
UNION ALL SELECT 'table_policy', 'src-' || p_size || '.' || p_type, 'maxRows',
'Number must be greater than or equal to 0', count(*) FROM part WHERE p_brand = 'Brand#8' GROUP BY ALL
UNION ALL SELECT 'agent_policy', 'agent-' || c_custkey, 'allowedClassifications', 'Invalid classification', count(*)
FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY ALL"""
)
def policy_violations(spark, sf_dir):
    """Every broken rule in policy tables spoiled on purpose."""
    b = big_bundle(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_pos"), "p_brand")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), "c_mktsegment")
    sources = b.sources.join(supplier, "pos").withColumns(
        {
            "name": F.when(F.col("s_nationkey") == 3, "").otherwise(F.col("name")),
            "type": F.when(F.col("s_nationkey") == 4, "oracle").otherwise(F.col("type")),
        }
    )
    raw = table(spark, sf_dir, "orders")
    rules = raw.select(
        F.when(F.col("o_totalprice") < 20000, "").otherwise(F.col("o_custkey").cast("string")).alias("agent"),
        F.concat(F.lit("src-"), (F.col("o_orderkey") % 50).cast("string")).alias("source"),
    )
    tables = b.table_policy.join(part, "table_pos").withColumns(
        {
            "classification": F.when(F.col("p_brand") == "Brand#7", "secret").otherwise(F.col("classification")),
            "max_rows": F.when(F.col("p_brand") == "Brand#8", -1).otherwise(F.col("max_rows")),
        }
    )
    spoiled = F.array(F.lit("public"), F.lit("top-secret"))
    agents = b.agent_policy.join(customer, "pos").withColumn(
        "allowed_classes", F.when(F.col("c_mktsegment") == "HOUSEHOLD", spoiled).otherwise(F.col("allowed_classes"))
    )
    bad = b.with_tables(sources=sources, scope_rules=rules, table_policy=tables, agent_policy=agents)
    return maintenance.policy_violations(bad).groupBy("policy_table", "key", "path", "message").agg(
        F.count("*").alias("n")
    )


@registered(
    with_sql(
        BIG_SQL,
        """SELECT DISTINCT source, "table" FROM all_rules WHERE "table" IS NOT NULL AND (source, "table") NOT IN
(SELECT ('src-' || CAST(p_size AS VARCHAR), p_type) FROM part)""",
    )
)
def tables_without_policy(spark, sf_dir):
    """Tables named by scopes that fall back to their source's default class."""
    bundle = big_bundle(spark, sf_dir)
    catalog = bundle.scope_rules.select("source", "table").filter("table is not null")
    return maintenance.tables_without_policy(catalog, bundle)


@registered(
    with_sql(
        BIG_SQL | {"kept": "SELECT DISTINCT agent FROM all_rules WHERE scope_pos % 3 = 0"},
        """SELECT 'no scope' AS finding, agent FROM ap WHERE agent NOT IN (SELECT agent FROM kept)
UNION ALL SELECT 'covered', agent FROM kept WHERE agent IN (SELECT agent FROM ap)
UNION ALL SELECT 'no policy', agent FROM (SELECT DISTINCT 'x-' || agent AS agent FROM kept)""",
    )
)
def agent_coverage(spark, sf_dir):
    """Agents with a policy but no scope, with both, and with a scope only."""
    bundle = big_bundle(spark, sf_dir)
    kept = bundle.scope_rules.filter("scope_pos % 3 = 0")
    own = bundle.with_tables(scope_rules=kept)
    foreign = bundle.with_tables(scope_rules=kept.withColumn("agent", F.concat(F.lit("x-"), "agent")))
    parts = [
        ("no scope", maintenance.agents_without_scope(own)),
        ("covered", maintenance.agents_covered(own)),
        ("no policy", maintenance.agents_without_policy(foreign)),
    ]
    shown = [df.select(F.lit(name).alias("finding"), "agent") for name, df in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# ── view catalog ───────────────────────────────────────────────────

_VIEWS_SQL = {
    "listed": project_sql(
        {
            "source": "'src-' || CAST(s_suppkey AS string)",
            "kind": "CASE s_nationkey % 9 WHEN 0 THEN 'rest' WHEN 1 THEN 'postgres' WHEN 2 THEN 'mysql'"
            " WHEN 3 THEN 'mariadb' WHEN 4 THEN 'bigquery' WHEN 5 THEN 'spanner' WHEN 6 THEN 'alloydb'"
            " WHEN 7 THEN 'cloud-sql-mysql' ELSE 'cloud-sql-postgres' END",
        },
        "supplier",
    ),
    "entries": "SELECT scope_pos, source, min(source_pos) AS source_pos FROM all_rules GROUP BY scope_pos, source",
    "named": """SELECT r.*, kind, coalesce(r."table", '*') AS t,
lower(regexp_replace('query_' || source || '_' || coalesce(r."table", '*') || '_' || agent, '[^a-zA-Z0-9_-]', '_', 'g'))
AS name FROM all_rules r JOIN entries USING (scope_pos, source, source_pos) JOIN listed USING (source)
WHERE kind <> 'rest' AND rule_pos IS NOT NULL""",
    "views": """SELECT n.*, tp.max_rows AS cap FROM (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY
scope_pos, rule_pos) AS rn FROM named) n LEFT JOIN tp ON tp.source = n.source AND tp."table" = n.t WHERE rn = 1""",
}


@registered(
    with_sql(
        BIG_SQL | _VIEWS_SQL,
        """SELECT name, kind || '-sql' AS type, source, 'Query ' || t || ' in ' || source || ' (agent: ' || agent || ')' ||
CASE WHEN fields IS NOT NULL THEN ' — fields: ' || array_to_string(fields, ', ') ELSE '' END AS description,
CASE WHEN t = '*' THEN 'agent,table' ELSE 'agent' END AS parameters,
'SELECT ' || coalesce(array_to_string(fields, ', '), '*') || ' FROM ' || CASE WHEN t = '*' THEN '{{.table}}' ELSE t END ||
coalesce(' WHERE ' || array_to_string(list_transform(filters, lambda f, i: f.key || ' = $' || i), ' AND '), '') AS statement,
CASE WHEN cap > 0 THEN CAST(cap AS BIGINT) END AS max_rows FROM views""",
    )
)
def view_rows(spark, sf_dir):
    """Names, statements, descriptions, parameters and caps of the views scopes describe."""
    views = viewcatalog.view_rows(big_bundle(spark, sf_dir))
    return views.select(
        "name", "type", "source", "description", F.array_join("parameters", ",").alias("parameters"), "statement",
        "max_rows",
    )


@registered(
    with_sql(BIG_SQL | _VIEWS_SQL, "SELECT source || '_tools' AS name, name AS \"view\", scope_pos, rule_pos FROM views")
)
def view_groups(spark, sf_dir):
    return viewcatalog.view_groups(viewcatalog.view_rows(big_bundle(spark, sf_dir)))


@registered(
    with_sql(
        {"listed": _VIEWS_SQL["listed"]},
        """SELECT 'query__' || source AS name, kind AS type, 'Query the "' || source || '" ' || kind ||
' data source. Credentials stay with the reader; access is scoped and audited.' AS description FROM listed""",
    )
)
def source_view_list(spark, sf_dir):
    return viewcatalog.source_views(big_bundle(spark, sf_dir))


@registered(
    with_sql({"listed": _VIEWS_SQL["listed"]}, "SELECT source AS name, kind AS type FROM listed WHERE kind <> 'rest'")
)
def database_sources(spark, sf_dir):
    return viewcatalog.database_sources(big_bundle(spark, sf_dir)).select("name", "type")


# ── sources ────────────────────────────────────────────────────────


@registered("SELECT c_custkey, c_name, c_acctbal FROM customer")
def registry_scan(spark, sf_dir):
    return registry(sf_dir).load(spark, "people_db", "customer").select("c_custkey", "c_name", "c_acctbal")


@registered(
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{t}' AS \"table\", true AS reachable FROM (SELECT count(*) FROM {t}) WHERE true"
        for s in ("warehouse", "people_db")
        for t in (
            "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
            " conversations"
        ).split()
    )
)
def source_probe(spark, sf_dir):
    return registry(sf_dir).probe(spark).select("source", "table", "reachable")


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def landed_json(spark, sf_dir):
    """REST payloads as landed files, one object each; the array form is covered by the tests."""
    path = fresh_path(spark, "landed")
    nation = table(spark, sf_dir, "nation")
    nation.write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_landed_json(spark, path, nation.schema)


# ── streams, drained over the whole event log ──────────────────────


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return streams.stream_files(spark, f"{sf_dir}/events*.parquet", schema)


def _drained(spark, df):
    path = fresh_path(spark, "stream")
    streams.drain(streams.run_to_files(df, path, fresh_path(spark, "state"), availableNow=True))
    return spark.read.schema(df.schema).parquet(path)


def _drained_windows(spark, df):
    path = fresh_path(spark, "windows")
    streams.drain(streams.run_to_windows(df, path, fresh_path(spark, "state"), availableNow=True))
    return streams.read_windows(spark, path, df.schema)


@registered(
    with_sql(
        AUDIT_SQL,
        """SELECT agent_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, count(*) AS requests FROM audit
GROUP BY ALL HAVING count(*) > 3""",
    )
)
def stream_rate_limit(spark, sf_dir):
    entries = project(_event_stream(spark, sf_dir), AUDIT_COLUMNS)
    return _drained_windows(spark, streams.stream_rate_limit(entries, 3, "1 hour"))


@registered(
    with_sql(
        AUDIT_SQL
        | {
            "ap": _LIMITS,
            "used": """SELECT agent_id, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start,
CAST(sum(row_count) AS BIGINT) AS rows FROM audit GROUP BY ALL""",
        },
        """SELECT agent_id, window_start, rows, CAST(coalesce(max_rows, 100) AS BIGINT) AS max_rows FROM used
LEFT JOIN ap ON agent = agent_id WHERE rows > coalesce(max_rows, 100)""",
    )
)
def stream_row_quota(spark, sf_dir):
    entries = project(_event_stream(spark, sf_dir), AUDIT_COLUMNS)
    return _drained_windows(spark, streams.stream_row_quota(entries, small_bundle(spark), "1 day"))


@registered(ORACLES["peak_concurrency"])
def stream_peak_concurrency(spark, sf_dir):
    """The highest number of requests of an agent at one time, kept up as they arrive."""
    entries = project(_event_stream(spark, sf_dir), AUDIT_COLUMNS)
    df, path = streams.stream_peak_concurrency(entries, small_bundle(spark)), fresh_path(spark, "windows")
    streams.drain(streams.run_to_windows(df, path, fresh_path(spark, "state"), availableNow=True))
    streams.fold_windows(spark, path, ["agent_id"])
    return streams.read_windows(spark, path, df.schema, ["agent_id"])


@registered(
    with_sql(
        _NONE_GRANTED | _ALL_READABLE | _OUTCOMES,
        """SELECT request_id AS seq, agent AS agent_id, source, "table" AS resource,
CASE WHEN stage = 'permitted' THEN 'permitted' ELSE 'denied' END AS policy_decision FROM told""",
    )
)
def stream_decisions_stored(spark, sf_dir):
    """The same decisions from stored policy tables of unknown size."""
    stored = small_bundle(spark).with_tables()
    asked = project(_event_stream(spark, sf_dir), REQUEST_COLUMNS)
    shown = _drained(spark, streams.stream_audit_entries(asked, stored))
    return shown.select("seq", "agent_id", "source", "resource", "policy_decision")


@registered(with_sql(AUDIT_SQL, f"SELECT {_AUDIT_COLS} FROM audit"))
def audit_mixed_writers(spark, sf_dir):
    """A stream and batches append to one trail; readers see all of it."""
    path = fresh_path(spark, "audit")
    entries = audit(spark, sf_dir)
    audit_log.append_audit(entries.filter("seq % 3 = 0"), path)
    streamed = project(_event_stream(spark, sf_dir), AUDIT_COLUMNS).filter("seq % 3 = 1")
    streams.drain(audit_log.append_audit_stream(streamed, path, fresh_path(spark, "state"), availableNow=True))
    audit_log.append_audit(entries.filter("seq % 3 = 2"), path)
    return audit_log.read_audit(spark, path)


@registered(
    with_sql(
        _NONE_GRANTED | _ALL_READABLE | _OUTCOMES,
        """SELECT request_id AS seq, agent AS agent_id, source, "table" AS resource,
CASE WHEN stage = 'permitted' THEN 'permitted' ELSE 'denied' END AS policy_decision FROM told""",
    )
)
def stream_decisions(spark, sf_dir):
    """Decisions as requests arrive, appended to an audit trail of JSON lines."""
    path = fresh_path(spark, "audit")
    asked = project(_event_stream(spark, sf_dir), REQUEST_COLUMNS)
    entries = streams.stream_audit_entries(asked, small_bundle(spark))
    query = audit_log.append_audit_stream(entries, path, fresh_path(spark, "state"), availableNow=True)
    streams.drain(query)
    stored = audit_log.read_audit(spark, path)
    return stored.select("seq", "agent_id", "source", "resource", "policy_decision")


@registered(
    """SELECT c_custkey, 'name-' || right(c_name, 4) AS c_name, c_mktsegment, CASE WHEN c_acctbal IS NOT NULL THEN
'***REDACTED***' END AS c_acctbal FROM customer WHERE c_acctbal > 0"""
)
def stream_governed_table(spark, sf_dir):
    """A governed table over a stream of files; no row cap."""
    schema = table(spark, sf_dir, "customer").schema
    stream = streams.stream_files(spark, f"{sf_dir}/customer*.parquet", schema)
    access = enforce.check_access(small_bundle(spark), "steward", "warehouse", ["customer"])["customer"]
    return _drained(spark, streams.stream_governed(stream, access))
