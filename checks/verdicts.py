"""Policy lookups, decisions, scopes, request outcomes, log parsing."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from checks.relations import (
    BIG_REQUEST_COLUMNS,
    BIG_REQUESTS_SQL,
    BIG_SQL,
    DECIDED,
    DECISION_COLUMNS,
    DECISION_SELECT,
    REQUESTS_SQL,
    SCOPED,
    SMALL_SQL,
    TEXT_REQUESTS_SQL,
    big_bundle,
    big_requests,
    flat_decision,
    flat_filters,
    flat_scope,
    parsed_requests,
    project,
    project_sql,
    rank_sql,
    registered,
    requests,
    small_bundle,
    table,
    with_sql,
)
from palisade.functions import querytext
from palisade.functions.classes import class_rank, clearance
from palisade.operators import decisions, history, lookups, scope
from palisade.plans import outcome

_SMALL = REQUESTS_SQL | SMALL_SQL | DECIDED
_BIG = BIG_REQUESTS_SQL | BIG_SQL | DECIDED


@registered(
    with_sql(
        _BIG,
        """SELECT agent, has_policy, count(*) AS n, CAST(max(rnk) AS INTEGER) AS rnk, CAST(max(agent_cap) AS BIGINT)
AS max_rows FROM (SELECT *, agent IN (SELECT agent FROM ap) AS known FROM looked) GROUP BY agent, has_policy""",
    )
)
def agent_policy_lookup(spark, sf_dir):
    """Explicit policy, else the default one."""
    bundle = big_bundle(spark, sf_dir)
    found = lookups.with_agent_policy(big_requests(spark, sf_dir), bundle)
    marked = found.join(bundle.agent_policy.select("agent").distinct().withColumn("has", F.lit(True)), "agent", "left")
    return marked.groupBy("agent", F.col("has").isNotNull().alias("has_policy")).agg(
        F.count("*").alias("n"),
        F.max("agent_policy.rank").alias("rnk"),
        F.max("agent_policy.max_rows").alias("max_rows"),
    )


@registered(with_sql(_BIG, "SELECT source, default_class FROM sp"))
def source_policy_lookup(spark, sf_dir):
    return lookups.source_lookup(big_bundle(spark, sf_dir)).select("source", "default_class")


@registered(
    with_sql(
        _BIG,
        'SELECT source, "table", classification, row_filter, CAST(max_rows AS BIGINT) AS max_rows, approve,'
        " table_pos FROM tp",
    )
)
def table_policy_lookup(spark, sf_dir):
    """First policy per table among those of the source's first policy entry."""
    found = lookups.table_lookup(big_bundle(spark, sf_dir))
    return found.select(
        "source", "table", "classification", "row_filter", "max_rows", F.col("approve_writes").alias("approve"),
        "table_pos",
    )


@registered(
    with_sql(
        _SMALL,
        """SELECT r.request_id, c.name, c.classification, c.masking, c.mask_format FROM (SELECT request_id, source,
"table", unnest("columns") AS name FROM reqs) r JOIN cp c USING (source, "table", name)""",
    )
)
def column_policy_lookup(spark, sf_dir):
    found = decisions.column_policies_of(parsed_requests(spark, sf_dir), small_bundle(spark))
    return found.select("request_id", "name", "classification", "masking", "mask_format")


@registered(
    f"""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'AUTOMOBILE' THEN 0 WHEN 'FURNITURE' THEN 2
WHEN 'HOUSEHOLD' THEN 6 ELSE 0 END AS clearance, {rank_sql("lower(c_mktsegment)")}::INTEGER AS label_rank,
coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN -1 WHEN 'AUTOMOBILE' THEN 0 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD'
THEN 6 ELSE 0 END >= c_nationkey % 7, false) AS cleared FROM customer"""
)
def clearance_test(spark, sf_dir):
    """Highest allowed rank against the rank asked for; an empty list clears nothing and an
    unknown class ranks lowest."""
    allowed = (
        "CASE c_mktsegment WHEN 'BUILDING' THEN CAST(array() AS array<string>) WHEN 'AUTOMOBILE' THEN array('public')"
        " WHEN 'FURNITURE' THEN array('confidential', 'public') WHEN 'HOUSEHOLD' THEN array('pci')"
        " ELSE array('made-up') END"
    )
    asked = (
        "element_at(array('public','internal','confidential','restricted','pii','phi','pci'),"
        " CAST(1 + c_nationkey % 7 AS int))"
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr(clearance(allowed)).alias("clearance"),
        F.expr(class_rank("lower(c_mktsegment)")).alias("label_rank"),
        F.expr(f"{class_rank(asked)} <= {clearance(allowed)}").alias("cleared"),
    )


@registered(with_sql(_BIG, "SELECT operation, op_ok, src_ok, cls, count(*) AS n FROM tested GROUP BY ALL"))
def request_gates(spark, sf_dir):
    """Operation gate, source allow-list and effective class over all requests."""
    found = decisions.with_policies(big_requests(spark, sf_dir), lookups.resolve(big_bundle(spark, sf_dir)))
    tested = found.selectExpr("operation", "_operation_ok AS op_ok", "_source_ok AS src_ok", "_class AS cls")
    return tested.groupBy("operation", "op_ok", "src_ok", "cls").agg(F.count("*").alias("n"))


@registered(with_sql(_SMALL, DECISION_SELECT))
def governance_decision(spark, sf_dir):
    return flat_decision(decisions.decide(parsed_requests(spark, sf_dir), small_bundle(spark)))


@registered(with_sql(_SMALL, DECISION_SELECT))
def governance_decision_unhinted(spark, sf_dir):
    """The same decisions by the path for policies of unknown size."""
    return flat_decision(decisions.decide(parsed_requests(spark, sf_dir), small_bundle(spark).with_tables()))


@registered(with_sql(_BIG, DECISION_SELECT))
def governance_decision_large(spark, sf_dir):
    """Every line item as a request, against policies that grow with the data."""
    bundle = big_bundle(spark, sf_dir)
    return flat_decision(decisions.decide(big_requests(spark, sf_dir), bundle))


@registered(
    with_sql(
        _SMALL,
        """SELECT request_id, masked FROM dec WHERE masked <> ''""",
    )
)
def masked_columns_of_request(spark, sf_dir):
    judged = flat_decision(decisions.decide(parsed_requests(spark, sf_dir), small_bundle(spark)))
    return judged.filter("masked <> ''").select("request_id", "masked")


@registered(
    with_sql(
        _BIG,
        "SELECT operation, agent_approve, table_approve, operation IN ('INSERT','UPDATE','DELETE') AND (agent_approve"
        " OR table_approve) AS needed, count(*) AS n FROM looked GROUP BY ALL",
    )
)
def write_approval_flag(spark, sf_dir):
    found = decisions.with_policies(big_requests(spark, sf_dir), lookups.resolve(big_bundle(spark, sf_dir)))
    flags = found.selectExpr(
        "operation",
        "_agent_approve AS agent_approve",
        "coalesce(_table_approve, true) AS table_approve",
        f"{decisions.APPROVAL} AS needed",
    )
    return flags.groupBy("operation", "agent_approve", "table_approve", "needed").agg(F.count("*").alias("n"))


_READS = {"reqs": """SELECT request_id, agent, source, "table", 'SELECT' AS operation, [] :: VARCHAR[] AS "columns"
FROM reqs0"""}  # fmt: skip


@registered(
    with_sql(
        {"reqs0": REQUESTS_SQL["reqs"]} | _READS | SMALL_SQL | DECIDED,
        "SELECT request_id, allowed, why AS reason FROM dec",
    )
)
def preflight(spark, sf_dir):
    asked = parsed_requests(spark, sf_dir).select("request_id", "agent", "source", "table")
    answered = decisions.preflight(asked, small_bundle(spark))
    return answered.select("request_id", "allowed", "reason")


@registered(
    with_sql(
        {"reqs0": BIG_REQUESTS_SQL["reqs"]} | _READS | BIG_SQL | DECIDED,
        'SELECT DISTINCT agent, source, "table", allowed, why AS reason FROM dec',
    )
)
def access_matrix(spark, sf_dir):
    """Preflight of every (agent, source, table) the log mentions."""
    return decisions.access_matrix(big_requests(spark, sf_dir), lookups.resolve(big_bundle(spark, sf_dir)))


@registered(
    with_sql(
        {"pairs0": "SELECT DISTINCT agent, source FROM (" + BIG_REQUESTS_SQL["reqs"] + ")"}
        | {
            "cat": "SELECT DISTINCT 'src-' || CAST(p_size AS VARCHAR) AS source, p_type AS \"table\" FROM part",
            "reqs": """SELECT 0 AS request_id, agent, source, "table", 'SELECT' AS operation, [] :: VARCHAR[] AS "columns"
FROM pairs0 JOIN cat USING (source)""",
        }
        | BIG_SQL
        | DECIDED,
        "SELECT agent, source, count(*) AS tables_total, count(*) FILTER (allowed) AS tables_allowed FROM dec GROUP BY ALL",
    )
)
def clearance_coverage(spark, sf_dir):
    """Tables readable per agent and source, from a histogram of ranks per source."""
    catalog = table(spark, sf_dir, "part").select(
        F.concat(F.lit("src-"), F.col("p_size").cast("string")).alias("source"), F.col("p_type").alias("table")
    )
    return decisions.clearance_coverage(big_requests(spark, sf_dir), catalog, big_bundle(spark, sf_dir))


_SCOPE_SELECT = "SELECT request_id, permitted, scope_why AS reason, fields, filters FROM sco"


@registered(with_sql(REQUESTS_SQL | SMALL_SQL | SCOPED, _SCOPE_SELECT))
def scope_decision(spark, sf_dir):
    return flat_scope(scope.scope_decision(parsed_requests(spark, sf_dir), small_bundle(spark)))


@registered(with_sql(BIG_REQUESTS_SQL | BIG_SQL | SCOPED, _SCOPE_SELECT))
def scope_decision_large(spark, sf_dir):
    """Rules from every order: wildcards, shadowed scopes, ordered union, last value wins."""
    bundle = scope.resolve_scopes(big_bundle(spark, sf_dir))
    return flat_scope(scope.scope_decision(big_requests(spark, sf_dir), bundle))


@registered(
    with_sql(
        BIG_SQL
        | {
            "reqs": """SELECT DISTINCT agent, source, "table" FROM rules WHERE rule_pos IS NOT NULL""",
            "hits": """SELECT p.agent, p.source, p."table", r.rule_pos, r.fields, r.filters FROM reqs p JOIN rules r
  ON r.agent = p.agent AND r.source = p.source AND (r."table" IS NULL OR r."table" = p."table")
  WHERE r.rule_pos IS NOT NULL""",
        }
        | {k: SCOPED[k] for k in ("f1", "f2", "f3", "g1", "g2", "g3")},
        """SELECT r.agent, r.source, r."table", f3.fields, g3.filters FROM reqs r
LEFT JOIN f3 ON f3.agent = r.agent AND f3.source = r.source AND f3."table" IS NOT DISTINCT FROM r."table"
LEFT JOIN g3 ON g3.agent = r.agent AND g3.source = r.source AND g3."table" IS NOT DISTINCT FROM r."table\"""",
    )
)
def rule_merge(spark, sf_dir):
    merged = scope.merge_rules(big_bundle(spark, sf_dir))
    return merged.select(
        "agent",
        "source",
        "table",
        F.array_join("fields", ",").alias("fields"),
        flat_filters(F.col("filters")).alias("filters"),
    )


# ── outcomes of raw request texts ──────────────────────────────────

_GAP = r"[\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NOT_GAP = _GAP.replace("[", "[^", 1)


def table_sql(q: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({q}, '[Ff][Rr][Oo][Mm]{_GAP}+([0-9A-Za-z_]+)', 1), ''),"
        f" nullif(regexp_extract({q}, '\\A({_NOT_GAP}*)', 1), ''), 'unknown')"
    )


def trim_sql(q: str) -> str:
    return f"regexp_replace(regexp_replace({q}, '\\A{_GAP}+', ''), '{_GAP}+\\z', '')"


def operation_sql(q: str) -> str:
    head = f"upper({trim_sql(q)})"
    return (
        f"CASE WHEN starts_with({head}, 'INSERT') THEN 'INSERT' WHEN starts_with({head}, 'UPDATE') THEN 'UPDATE'"
        f" WHEN starts_with({head}, 'DELETE') THEN 'DELETE' ELSE 'SELECT' END"
    )


def columns_sql(q: str) -> str:
    listed = (
        f"regexp_extract({q}, '[Ss][Ee][Ll][Ee][Cc][Tt]{_GAP}+([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){_GAP}+"
        f"[Ff][Rr][Oo][Mm]', 1)"
    )
    item = trim_sql("c")
    alias = f"nullif(regexp_extract({item}, '{_GAP}+[Aa][Ss]{_GAP}+([0-9A-Za-z_]+)\\z', 1), '')"
    dotted = f"nullif(regexp_extract({item}, '\\.([0-9A-Za-z_]+)\\z', 1), '')"
    names = f"list_transform(string_split({listed}, ','), lambda c: coalesce({alias}, {dotted}, {item}))"
    return (
        f"CASE WHEN {listed} = '' OR {trim_sql(listed)} = '*' THEN [] :: VARCHAR[]"
        f" ELSE list_filter({names}, lambda n: n <> '') END"
    )


_PARSED = f"""SELECT *, {table_sql('query')} AS "table", {operation_sql('query')} AS operation,
{columns_sql('query')} AS "columns" FROM logged"""


@registered(
    with_sql(
        TEXT_REQUESTS_SQL | {"reqs": _PARSED},
        "SELECT request_id, \"table\", operation, array_to_string(\"columns\", ',') AS names,"
        " CAST(length(query) AS INTEGER) AS query_length FROM reqs",
    )
)
def parse_query_log(spark, sf_dir):
    """Table, operation, columns and length of logged query texts."""
    logged = requests(spark, sf_dir)
    parsed = logged.select("request_id", *querytext.parse_query(F.col("query")))
    return parsed.select(
        "request_id", "table", "operation", F.array_join("columns", ",").alias("names"), "query_length"
    )


@registered(
    f"""SELECT doc_id, {table_sql('q')} AS "table", {operation_sql('q')} AS operation,
array_to_string({columns_sql('q')}, ',') AS names, CAST(length(q) AS INTEGER) AS query_length FROM (SELECT doc_id,
CASE WHEN doc_id % 3 = 0 THEN 'Select ' || text || chr(10) || ' FROM  ' || source || ' x' WHEN doc_id % 3 = 1
THEN ' ' || text ELSE text END AS q FROM documents)"""
)
def parse_free_text(spark, sf_dir):
    """The same over whole free texts, some wrapped into a query."""
    text = F.col("text")
    wrapped = F.concat(F.lit("Select "), text, F.lit("\n FROM  "), F.col("source"), F.lit(" x"))
    kind = F.col("doc_id") % 3
    q = F.when(kind == 0, wrapped).when(kind == 1, F.concat(F.lit(" "), text)).otherwise(text)
    parsed = table(spark, sf_dir, "documents").select("doc_id", *querytext.parse_query(q))
    return parsed.select("doc_id", "table", "operation", F.array_join("columns", ",").alias("names"), "query_length")


_OUTCOME = {
    "staged": """SELECT s.*, d.allowed, d.why, d.requires_approval, d.masked FROM sco s JOIN dec d USING (request_id)""",
    "ended": """SELECT *, CASE
  WHEN agent IS NULL OR agent = '' OR query IS NULL OR query = '' THEN 'missing_params'
  WHEN source NOT IN (SELECT name FROM known) THEN 'unknown_source'
  WHEN NOT permitted THEN 'scope_denied'
  WHEN NOT allowed THEN 'governance_denied'
  WHEN requires_approval AND request_id NOT IN (SELECT id FROM granted) THEN 'approval_required'
  WHEN source NOT IN (SELECT name FROM readable) THEN 'no_source_reader' ELSE 'permitted' END AS stage FROM staged""",
    "told": """SELECT *, CASE stage WHEN 'missing_params' THEN 'Missing required parameters: query and agent'
  WHEN 'unknown_source' THEN 'Unknown source: ' || source || '. Available: people_db, parts_hub, warehouse, cold_store, feed_api'
  WHEN 'scope_denied' THEN 'Access denied: ' || scope_why
  WHEN 'governance_denied' THEN 'Governance denied: ' || why
  WHEN 'approval_required' THEN 'Write operation blocked: ' || operation || ' on ' || source || '.' || "table" ||
    ' requires approval.'
  WHEN 'no_source_reader' THEN 'No connector available for source: ' || source END AS reason FROM ended""",
}
_GRANTED = {"granted": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'"}
_OUTCOMES = TEXT_REQUESTS_SQL | {"reqs": _PARSED} | SMALL_SQL | SCOPED | DECIDED | _OUTCOME
_NONE_GRANTED = {"granted": "SELECT -1 AS id"}
_ALL_READABLE = {"readable": SMALL_SQL["known"]}


def _outcomes(spark, sf_dir, **options):
    return outcome.request_outcome(requests(spark, sf_dir), small_bundle(spark), **options)


@registered(with_sql(_NONE_GRANTED | _ALL_READABLE | _OUTCOMES, "SELECT request_id, stage, reason FROM told"))
def request_outcome_stored(spark, sf_dir):
    """The same texts from stored policies of unknown size, the list of sources included."""
    ended = outcome.request_outcome(requests(spark, sf_dir), small_bundle(spark).with_tables())
    return ended.select("request_id", "stage", "reason")


@registered(
    with_sql(
        _GRANTED | {"readable": "SELECT 'warehouse' AS name"} | _OUTCOMES,
        'SELECT request_id, "table", operation, stage, reason FROM told',
    )
)
def request_outcome(spark, sf_dir):
    """From raw text to verdict, with approvals and one source without a reader."""
    approvals = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    ended = _outcomes(
        spark,
        sf_dir,
        approvals=approvals.select(F.col("o_orderkey").alias("request_id")),
        readers=["warehouse"],
    )
    return ended.select("request_id", "table", "operation", "stage", "reason")


@registered(
    with_sql(
        _NONE_GRANTED | _ALL_READABLE | _OUTCOMES,
        """SELECT request_id AS seq, ts AS timestamp, agent AS agent_id, source, 'BATCH_QUERY' AS action,
"table" AS resource, CAST(NULL AS BIGINT) AS row_count, CASE WHEN stage = 'permitted' THEN 'permitted' ELSE 'denied' END
AS policy_decision, CAST(NULL AS BIGINT) AS duration_ms FROM told""",
    )
)
def audit_from_decisions(spark, sf_dir):
    from palisade.operators.audit import audit_of_outcomes

    return audit_of_outcomes(_outcomes(spark, sf_dir))


_HTTP = {
    "reqs": f"""SELECT request_id, ts, agent, nullif(source, 'feed_api') AS source, query,
{table_sql("coalesce(query, '')")} AS "table" FROM logged""",
}


@registered(
    with_sql(
        TEXT_REQUESTS_SQL | _HTTP | SMALL_SQL | SCOPED,
        """SELECT request_id, "table", CASE WHEN source IS NULL OR source = '' OR agent IS NULL OR agent = '' THEN 400
WHEN source NOT IN (SELECT name FROM known) THEN 404 WHEN NOT permitted THEN 403 ELSE 200 END AS status_code,
CASE WHEN source IS NULL OR source = '' THEN 'Missing source name' WHEN agent IS NULL OR agent = ''
THEN 'Missing agent identifier' WHEN source NOT IN (SELECT name FROM known) THEN 'Source not found'
WHEN NOT permitted THEN 'Access denied: ' || scope_why END AS reason FROM sco""",
    )
)
def scope_only_outcome(spark, sf_dir):
    """Presence, source and scope only; status codes."""
    asked = requests(spark, sf_dir).withColumn("source", F.nullif("source", F.lit("feed_api")))
    return outcome.scope_only_outcome(asked, small_bundle(spark)).select(
        "request_id", "table", "status_code", "reason"
    )


# ── what-if ────────────────────────────────────────────────────────


def _stricter(spark):
    """The small bundle with a change of mind about two agents and one table."""
    import copy

    from checks.relations import CONFIG
    from palisade.sources.policy import Bundle

    config = copy.deepcopy(CONFIG)
    g = config["governance"]
    g["agentPolicies"][2]["allowedClassifications"] = ["public"]
    g["agentPolicies"][0]["maxRowsPerQuery"] = 50
    g["sourcePolicies"][0]["tables"][1]["classification"] = "confidential"
    return Bundle.from_config(spark, config)


_STRICT_SQL = {
    "ap": SMALL_SQL["ap"].replace("'planner', 2,", "'planner', 0,").replace(" 3200,", " 50,"),
    "tp": SMALL_SQL["tp"].replace("'orders', 'internal'", "'orders', 'confidential'"),
}
_FIELDS = ("allowed", "why", "masked", "row_filter", "max_rows", "requires_approval")


def _as_of(suffix: str, parts: dict[str, str], names=(*SMALL_SQL, *DECIDED)) -> dict[str, str]:
    """The decision SQL under other names, for a second policy set."""
    import re

    swap = lambda text: re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", lambda m: f"{m[1]} {m[2]}{suffix}", text)
    return {n + suffix: swap(parts[n]) for n in names}


_DIFF = _SMALL | _as_of("2", SMALL_SQL | DECIDED | _STRICT_SQL)
_CHANGED = " OR ".join(f"a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS)


@registered(
    with_sql(
        _DIFF,
        f"""SELECT request_id, a.allowed AS before_allowed, b.allowed AS after_allowed, b.why AS after_reason,
CAST(a.max_rows AS BIGINT) AS before_max, CAST(b.max_rows AS BIGINT) AS after_max FROM dec a JOIN dec2 b USING (request_id)
WHERE {_CHANGED}""",
    )
)
def what_if_diff(spark, sf_dir):
    """Requests whose decision a policy change would alter."""
    changed = decisions.what_if(parsed_requests(spark, sf_dir), small_bundle(spark), _stricter(spark))
    return changed.select(
        "request_id",
        F.col("before.allowed").alias("before_allowed"),
        F.col("after.allowed").alias("after_allowed"),
        F.col("after.reason").alias("after_reason"),
        F.col("before.max_rows").alias("before_max"),
        F.col("after.max_rows").alias("after_max"),
    )


@registered(
    with_sql(
        _DIFF,
        f"""SELECT request_id, a.allowed AS before_allowed, b.allowed AS after_allowed FROM
(SELECT * FROM dec WHERE operation <> 'UPDATE') a FULL OUTER JOIN (SELECT * FROM dec2 WHERE operation <> 'DELETE') b
USING (request_id) WHERE a.allowed IS NULL OR b.allowed IS NULL OR {_CHANGED}""",
    )
)
def decision_diff(spark, sf_dir):
    """Two decision runs over different logs: changed, added and dropped decisions."""
    asked = parsed_requests(spark, sf_dir)
    before = decisions.decide(asked.filter("operation <> 'UPDATE'"), small_bundle(spark))
    after = decisions.decide(asked.filter("operation <> 'DELETE'"), _stricter(spark))
    return decisions.decision_diff(before, after).select(
        "request_id",
        F.col("before.allowed").alias("before_allowed"),
        F.col("after.allowed").alias("after_allowed"),
    )


@registered(
    with_sql(
        _DIFF,
        f"""SELECT request_id, a.allowed AS before_allowed, b.allowed AS after_allowed, b.why AS after_reason,
CAST(a.max_rows AS BIGINT) AS before_max, CAST(b.max_rows AS BIGINT) AS after_max FROM dec a JOIN dec2 b USING (request_id)
WHERE {_CHANGED}""",
    )
)
def what_if_touched(spark, sf_dir):
    """The same as what_if_diff; only requests that the change concerns are judged."""
    before, after = small_bundle(spark).with_tables(), _stricter(spark).with_tables()
    changed = decisions.what_if_touched(parsed_requests(spark, sf_dir), before, after)
    return changed.select(
        "request_id",
        F.col("before.allowed").alias("before_allowed"),
        F.col("after.allowed").alias("after_allowed"),
        F.col("after.reason").alias("after_reason"),
        F.col("before.max_rows").alias("before_max"),
        F.col("after.max_rows").alias("after_max"),
    )


# ── policies as of the time of a request ───────────────────────────

_STARTS = [datetime(2024, 1, 5, 6), datetime(2024, 1, 15), datetime(2024, 1, 25)]
_NONE = {n: SMALL_SQL[n] + " WHERE false" for n in ("ap", "sp", "tp", "cp")}
_FREE = """SELECT request_id, true AS allowed, NULL AS reason, NULL AS masked, NULL AS row_filter, 0::BIGINT AS max_rows,
  false AS requires_approval FROM reqs"""
_HISTORY_SQL = with_sql(
    {"reqs": project_sql(DECISION_COLUMNS | {"ts": "ts"}, "events")}
    | SMALL_SQL
    | DECIDED
    | _as_of("0", SMALL_SQL | DECIDED | _NONE)
    | _as_of("2", SMALL_SQL | DECIDED | _STRICT_SQL),
    f"""{DECISION_SELECT}0 WHERE ts < '{_STARTS[0]}' UNION ALL
{DECISION_SELECT} WHERE ts >= '{_STARTS[0]}' AND ts < '{_STARTS[1]}' UNION ALL
{DECISION_SELECT}2 WHERE ts >= '{_STARTS[1]}' AND ts < '{_STARTS[2]}' UNION ALL
{_FREE} WHERE ts >= '{_STARTS[2]}'""",
)


def _versions(spark):
    """No policies at first, then the small bundle, a stricter one, and governance switched off."""
    first = small_bundle(spark)
    return list(zip(_STARTS, [first, _stricter(spark), replace(first, enabled=False)], strict=True))


def _timed_requests(spark, sf_dir):
    return project(table(spark, sf_dir, "events"), DECISION_COLUMNS | {"ts": "ts"})


@registered(_HISTORY_SQL)
def decisions_as_of(spark, sf_dir):
    """A log judged again across policy changes, each request by the policies of its time."""
    past = history.PolicyHistory.from_versions(spark, _versions(spark))
    return flat_decision(history.decide_as_of(_timed_requests(spark, sf_dir), past))


@registered(_HISTORY_SQL)
def decisions_as_of_grown(spark, sf_dir):
    """The same from a history that took in one version after the other, by the path for histories of any size."""
    (start, first), *later = _versions(spark)
    past = history.PolicyHistory.from_versions(spark, [(start, first.with_tables())])
    for start, bundle in later:
        past = past.extended(start, bundle.with_tables())
    return flat_decision(history.decide_as_of(_timed_requests(spark, sf_dir), past))


_LATER = {
    "ap": f"SELECT * REPLACE (max_rows + 7 AS max_rows) FROM ({BIG_SQL['ap']}) WHERE substr(agent, 7)::BIGINT % 3 <> 0",
    "tp": f"""SELECT * REPLACE (CASE WHEN table_pos % 2 = 0 THEN 'pci' ELSE classification END AS classification)
  FROM ({BIG_SQL['tp']})""",
}


@registered(
    with_sql(
        {"reqs": project_sql(BIG_REQUEST_COLUMNS | {"ts": "l_shipdate"}, "lineitem JOIN orders ON l_orderkey = o_orderkey")}
        | BIG_SQL
        | DECIDED
        | _as_of("2", DECIDED | _LATER, ("ap", "tp", *DECIDED)),
        f"""{DECISION_SELECT} WHERE ts < '1998-06-01' UNION ALL {DECISION_SELECT}2 WHERE ts >= '1998-06-01'""",
    )
)
def decisions_as_of_large(spark, sf_dir):
    """Every line item as a request of its ship date, against a history that grows with the data."""
    first = big_bundle(spark, sf_dir)
    level = F.when(F.col("table_pos") % 2 == 0, "pci").otherwise(F.col("classification"))
    second = first.with_tables(
        agent_policy=first.agent_policy.where("pos % 3 <> 0").withColumn("max_rows", F.col("max_rows") + 7),
        table_policy=first.table_policy.withColumn("classification", level),
    )
    past = history.PolicyHistory.from_versions(spark, [(datetime(1990, 1, 1), first), (datetime(1998, 6, 1), second)])
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    asked = project(lines.join(orders, lines.l_orderkey == orders.o_orderkey), BIG_REQUEST_COLUMNS | {"ts": "l_shipdate"})
    return flat_decision(history.decide_as_of(asked, past))
