"""Enforcement, governed SQL, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.relations import (
    CONFIG,
    DECIDED,
    REQUESTS_SQL,
    SMALL_SQL,
    home_region,
    parsed_requests,
    registered,
    registry,
    small_bundle,
    table,
    with_sql,
)
from palisade.functions.classes import rank_of
from palisade.functions.predicates import all_of, equality_filter, typed_predicate
from palisade.operators import decisions, enforce, writes
from palisade.plans.governed_sql import GovernedSession
from palisade.session import fresh_path
from palisade.sources.snapshots import SnapshotTable


def _governed(spark, sf_dir, agent, source, name, **options):
    return enforce.governed_table(spark, registry(sf_dir), small_bundle(spark), agent, source, name, **options)


@registered("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def scope_projection(spark, sf_dir):
    return enforce.scope_fields_of(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderdate"])


@registered("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3 AND l_discount = 0.05")
def scope_filter(spark, sf_dir):
    filters = {"l_returnflag": "R", "l_linenumber": 3, "l_discount": 0.05}
    return table(spark, sf_dir, "lineitem").filter(equality_filter(filters))


@registered("SELECT * FROM orders WHERE o_totalprice > 100000 OR o_orderpriority = '1-URGENT'")
def row_level_filter(spark, sf_dir):
    """A filter with OR stays whole, since it is never spliced into text."""
    return enforce.row_level(table(spark, sf_dir, "orders"), "o_totalprice > 100000 OR o_orderpriority = '1-URGENT'")


_GRAMMAR = [
    ("p_size", "gte", 5),
    ("p_size", "lt", 45),
    ("p_retailprice", "gt", 901.5),
    ("p_retailprice", "lte", 995.0),
    ("p_brand", "neq", "Brand#7"),
    ("p_type", "in", ["PROMO", "SMALL", "LARGE"]),
    ("p_type", "nin", ["LARGE"]),
    ("p_name", "contains", "e"),
]


@registered(
    """SELECT * FROM part WHERE p_size >= 5 AND p_size < 45 AND p_retailprice > 901.5 AND p_retailprice <= 995.0
AND p_brand <> 'Brand#7' AND p_type IN ('PROMO','SMALL','LARGE') AND p_type NOT IN ('LARGE') AND contains(p_name, 'e')"""
)
def typed_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(all_of(typed_predicate(*p) for p in _GRAMMAR))


@registered("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 20")
def typed_predicates_events(spark, sf_dir):
    wanted = [typed_predicate("event_type", "eq", "click"), typed_predicate("value", "gt", 20)]
    return table(spark, sf_dir, "events").filter(all_of(wanted)).select("event_id", "user_id")


@registered(
    """SELECT customer.* FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region
ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA')"""
)
def residency_filter(spark, sf_dir):
    """Rows of the listed regions, through the nation the row points to."""
    return enforce.reside(table(spark, sf_dir, "customer"), ["EUROPE", "ASIA"], home_region(spark, sf_dir))


@registered("SELECT * FROM documents WHERE lang IN ('en', 'de')")
def residency_by_column(spark, sf_dir):
    return enforce.reside(table(spark, sf_dir, "documents"), ["en", "de"], enforce.ResidencyKey("lang"))


@registered(
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 600"
)
def row_cap(spark, sf_dir):
    """The cap of a governed table as the outermost step of an ordered query."""
    result = _governed(spark, sf_dir, "steward", "warehouse", "orders")
    ordered = result.df.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return enforce.cap_rows(ordered, result.access.max_rows)


@registered(
    """SELECT c_custkey, 'name-' || right(c_name, 4) AS c_name, c_mktsegment, CASE WHEN c_acctbal IS NOT NULL THEN
'***REDACTED***' END AS c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 3200"""
)
def governed_customer(spark, sf_dir):
    """Row filter on a raw value, masks, scope columns and cap of one governed table."""
    result = _governed(spark, sf_dir, "steward", "warehouse", "customer")
    return enforce.cap_rows(result.df.orderBy("c_custkey"), result.access.max_rows)


@registered(
    "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O'"
)
def governed_orders(spark, sf_dir):
    """All rows in scope, before the cap."""
    return _governed(spark, sf_dir, "order-desk", "warehouse", "orders").df


@registered(
    """SELECT c_custkey, 'tok_' || left(sha256(c_name), 12) AS c_name, c_nationkey FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('AFRICA', 'ASIA', 'MIDDLE EAST')"""
)
def governed_residents(spark, sf_dir):
    """Wildcard scope, residency through a lookup, tokens."""
    key = home_region(spark, sf_dir)
    return _governed(spark, sf_dir, "steward", "people_db", "customer", residency=key).df


def _customer_policies():
    return [dict(c) for c in CONFIG["governance"]["sourcePolicies"][0]["tables"][0]["columns"]]


@registered("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def column_clearance_drop(spark, sf_dir):
    return enforce.clear_columns(table(spark, sf_dir, "customer"), _customer_policies(), rank_of("pii"), "drop")


@registered(
    """SELECT c_custkey, '***REDACTED***' AS c_name, c_nationkey, '***REDACTED***' AS c_acctbal, c_mktsegment
FROM customer"""
)
def column_clearance_redact(spark, sf_dir):
    return enforce.clear_columns(table(spark, sf_dir, "customer"), _customer_policies(), rank_of("internal"), "redact")


# ── governed SQL ───────────────────────────────────────────────────

_ADMIN = {
    "customer": """SELECT c_custkey, 'name-' || right(c_name, 4) AS c_name, c_mktsegment,
  CASE WHEN c_acctbal IS NOT NULL THEN '***REDACTED***' END AS c_acctbal FROM main.customer WHERE c_acctbal > 0""",
}
_SCIENTIST = {"orders": "SELECT * FROM main.orders WHERE o_orderpriority = '1-URGENT'"}


def _sql(spark, sf_dir, agent, query):
    return GovernedSession(spark, registry(sf_dir), small_bundle(spark), agent, "warehouse").sql(query)


_SQL_JOIN = """SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty,
  count(DISTINCT o_orderkey) AS orders_seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_shipdate >= timestamp '1997-01-01 00:00:00' GROUP BY o_orderpriority, l_returnflag"""
_SQL_ALIAS = """WITH c AS (SELECT c_name AS secret, c_mktsegment AS seg, c_custkey AS k FROM customer)
  SELECT k, secret, seg FROM c ORDER BY k LIMIT 100"""
_SQL_SUBQUERY = """SELECT count(*) AS n, max(o_orderkey) AS newest FROM orders o WHERE EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 40) AND o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"""
_SQL_WINDOW = """SELECT l_orderkey, l_linenumber, total, place FROM (SELECT l_orderkey, l_linenumber, total,
  CAST(row_number() OVER (PARTITION BY l_linenumber
  ORDER BY total DESC, l_orderkey) AS int) AS place
  FROM (SELECT l_orderkey, l_linenumber, round(sum(l_quantity), 2) AS total FROM lineitem
  GROUP BY l_orderkey, l_linenumber) t) r WHERE place <= 5"""
_SQL_SETS = """SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region
  EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 2"""
_SQL_GROUPING = """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
  GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"""


@registered(with_sql(_SCIENTIST, _SQL_JOIN))
def governed_sql_join(spark, sf_dir):
    return _sql(spark, sf_dir, "planner", _SQL_JOIN)


@registered(with_sql(_ADMIN, _SQL_ALIAS.replace("WITH c AS", ", c AS")))
def governed_sql_alias(spark, sf_dir):
    """An alias in a CTE does not unmask."""
    return _sql(spark, sf_dir, "steward", _SQL_ALIAS)


@registered(with_sql(_SCIENTIST, _SQL_SUBQUERY))
def governed_sql_subquery(spark, sf_dir):
    return _sql(spark, sf_dir, "planner", _SQL_SUBQUERY)


@registered(_SQL_WINDOW)
def governed_sql_window(spark, sf_dir):
    return _sql(spark, sf_dir, "planner", _SQL_WINDOW)


@registered(_SQL_SETS)
def governed_sql_sets(spark, sf_dir):
    return _sql(spark, sf_dir, "map-reader", _SQL_SETS)


@registered(_SQL_GROUPING)
def governed_sql_grouping(spark, sf_dir):
    return _sql(spark, sf_dir, "steward", _SQL_GROUPING)


@registered(
    with_sql(
        _ADMIN,
        """SELECT c_mktsegment, c_acctbal, count(*) AS n, count(DISTINCT c_name) AS names FROM customer GROUP BY ALL""",
    )
)
def registered_views(spark, sf_dir):
    """Named views of one agent, then any DataFrame work in that session."""
    from palisade.operators.viewcatalog import register_views

    session = GovernedSession(spark, registry(sf_dir), small_bundle(spark), "steward", "warehouse")
    register_views(session, ["customer", "orders"])
    grouped = session.session.table("customer").groupBy("c_mktsegment", "c_acctbal")
    return grouped.agg(F.count("*").alias("n"), F.countDistinct("c_name").alias("names"))


# ── writes ─────────────────────────────────────────────────────────


@registered(
    with_sql(
        REQUESTS_SQL | SMALL_SQL | DECIDED,
        """SELECT request_id, operation, NOT requires_approval OR request_id IN (
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS released FROM dec
WHERE allowed AND operation IN ('INSERT','UPDATE','DELETE')""",
    )
)
def write_gate(spark, sf_dir):
    """Writes with and without an approval row."""
    judged = decisions.decide(parsed_requests(spark, sf_dir), small_bundle(spark))
    approvals = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    gated = writes.gate_writes(judged, approvals.select(F.col("o_orderkey").alias("request_id")))
    return gated.select("request_id", "operation", "released")


def _write_access(spark, name, operation):
    return enforce.check_access(small_bundle(spark), "steward", "warehouse", [name], operation)[name]


_NEW_CUSTOMERS = "SELECT s_suppkey + 1000000 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier"


def _new_customers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000000).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )


@registered(
    f"""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL
SELECT c_custkey, c_name, NULL, c_acctbal, 'SUPPLIER' FROM ({_NEW_CUSTOMERS}) WHERE c_acctbal > 0"""
)
def governed_insert(spark, sf_dir):
    """Insert into a stored copy; rows the row filter would hide are not accepted."""
    customer = table(spark, sf_dir, "customer")
    path = fresh_path(spark, "customer")
    writes.write_snapshot(customer, path)
    access = _write_access(spark, "customer", "INSERT")
    accepted = writes.governed_insert(customer, _new_customers(spark, sf_dir), access, approved=True).accepted
    writes.append_rows(accepted, path)
    return spark.read.schema(customer.schema).parquet(path)


@registered(
    f"""SELECT c_custkey, c_acctbal, c_acctbal > 0 AS accepted FROM ({_NEW_CUSTOMERS})"""
)
def governed_insert_parted(spark, sf_dir):
    """Every given row is accepted or rejected; an approval row releases the write."""
    customer = table(spark, sf_dir, "customer")
    approvals = table(spark, sf_dir, "region").select(
        F.lit("steward").alias("agent"), F.lit("warehouse").alias("source"), F.lit("customer").alias("table"),
        F.lit("INSERT").alias("operation"),
    )
    access = _write_access(spark, "customer", "INSERT")
    parts = writes.governed_insert(customer, _new_customers(spark, sf_dir), access, approved=approvals)
    shown = [df.select("c_custkey", "c_acctbal", F.lit(ok).alias("accepted")) for df, ok in zip(parts, (True, False))]
    return shown[0].unionByName(shown[1])


@registered(
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 0 THEN 100.0
ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 0 THEN 'LOW' ELSE c_mktsegment END
AS c_mktsegment FROM customer"""
)
def governed_update(spark, sf_dir):
    """Rows outside the row filter keep their values even where the condition holds."""
    access = _write_access(spark, "customer", "UPDATE")
    assign = {"c_acctbal": F.lit(100.0), "c_mktsegment": F.lit("LOW")}
    customer = table(spark, sf_dir, "customer")
    after = writes.governed_update(customer, assign, F.col("c_custkey") % 3 == 0, access, approved=True)
    path = fresh_path(spark, "customer")
    writes.write_snapshot(after, path)
    return spark.read.schema(after.schema).parquet(path)


def _partitioned(spark, sf_dir):
    """A stored copy of the customers by segment: its path and its rows."""
    source = table(spark, sf_dir, "customer")
    path = fresh_path(spark, "customer")
    source.repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return path, lambda: spark.read.schema(source.schema).parquet(path).select(*source.columns)


@registered(
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 AND c_custkey % 4 = 1 AND c_mktsegment IN
('BUILDING', 'HOUSEHOLD') THEN 1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""
)
def governed_update_partitions(spark, sf_dir):
    """Update in place of a partitioned copy: only partitions with a hit are written again."""
    access = _write_access(spark, "customer", "UPDATE")
    path, stored = _partitioned(spark, sf_dir)
    where = (F.col("c_custkey") % 4 == 1) & F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")
    change = lambda rows: writes.governed_update(rows, {"c_acctbal": F.lit(1.0)}, where, access, approved=True)
    writes.rewrite_partitions(stored(), where, change, path, ["c_mktsegment"])
    return stored()


@registered(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING'
THEN CASE WHEN c_custkey % 2 = 0 THEN 'HOUSEHOLD' ELSE 'NEW' END ELSE c_mktsegment END AS c_mktsegment FROM customer"""
)
def governed_update_moves(spark, sf_dir):
    """An update of the partition column moves rows to an old and to a new partition."""
    access = _write_access(spark, "customer", "UPDATE")
    path, stored = _partitioned(spark, sf_dir)
    where = F.col("c_mktsegment") == "BUILDING"
    to = F.when(F.col("c_custkey") % 2 == 0, "HOUSEHOLD").otherwise("NEW")
    change = lambda rows: writes.governed_update(rows, {"c_mktsegment": to}, where, access, approved=True)
    writes.rewrite_partitions(stored(), where, change, path, ["c_mktsegment"])
    return stored()


@registered("SELECT * FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0)")
def governed_delete(spark, sf_dir):
    access = _write_access(spark, "customer", "DELETE")
    where = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 == 0)
    return writes.governed_delete(table(spark, sf_dir, "customer"), where, access, approved=True)


@registered("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def governed_delete_partitions(spark, sf_dir):
    """A delete that empties a partition leaves nothing of it behind."""
    access = _write_access(spark, "orders", "DELETE")
    path = fresh_path(spark, "orders")
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    source.write.partitionBy("o_orderstatus").parquet(path)
    stored = lambda: spark.read.schema(source.schema).parquet(path).select(*source.columns)
    where = F.col("o_orderstatus") == "F"
    change = lambda rows: writes.governed_delete(rows, where, access, approved=True)
    writes.rewrite_partitions(stored(), where, change, path, ["o_orderstatus"])
    return stored()


@registered(
    """WITH after AS (
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 40 < 4 AND o_orderkey < 400 THEN 'HELD' ELSE o_orderpriority END
        AS o_orderpriority, o_orderstatus FROM orders WHERE NOT (o_orderkey BETWEEN 900 AND 1100 AND o_orderstatus = 'F')
    UNION ALL SELECT c_custkey - 1000000, c_custkey, NULL, 'O' FROM customer WHERE c_custkey % 50 = 0)
SELECT *, 4::BIGINT AS version, true AS few_files FROM after"""
)
def governed_table_versions(spark, sf_dir):
    """Update, delete and insert on a table of versions: few files are written again, each write is one version."""
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    stored = SnapshotTable.create(source, fresh_path(spark, "versions"), ["o_orderkey"], files=16)
    access = _write_access(spark, "orders", "UPDATE")
    where = (F.col("o_orderkey") % 40 < 4) & (F.col("o_orderkey") < 400)
    updated = writes.update_table(stored, {"o_orderpriority": F.lit("HELD")}, where, access, approved=True)
    gone = F.col("o_orderkey").between(900, 1100) & (F.col("o_orderstatus") == "F")
    writes.delete_from_table(stored, gone, _write_access(spark, "orders", "DELETE"), approved=True)
    new = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(
        (F.col("c_custkey") - 1000000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus")
    )
    writes.insert_into_table(stored, new, _write_access(spark, "orders", "INSERT"), approved=True)
    few = len(updated.removed) < 16
    return stored.read().select("*", F.lit(stored.version()).cast("long").alias("version"), F.lit(few).alias("few_files"))


@registered(
    """SELECT 'before' AS at, 'permitted' AS decision, count(*) AS rows FROM nation
UNION ALL SELECT 'after', 'denied', NULL::BIGINT"""
)
def governed_sql_audited(spark, sf_dir):
    """Governed SQL leaves its own audit records; a scope taken away shuts its tables at once."""
    from palisade.operators import maintenance
    from palisade.sources.audit_log import read_audit

    path, bundle = fresh_path(spark, "audit"), small_bundle(spark)
    session = GovernedSession(spark, registry(sf_dir), bundle, "map-reader", "warehouse", audit=path)
    session.run("SELECT n_name FROM Nation", lambda df: df.write.parquet(fresh_path(spark, "rows")), "before")
    session.bundle = maintenance.remove_scope(bundle, "map-reader")[0]
    try:
        session.run("SELECT n_name FROM nation", lambda df: df.count(), "after")
    except enforce.AccessDenied:
        pass
    stored = read_audit(spark, path)
    at = F.when(F.col("action") == "before", "before").otherwise("after")
    return stored.select(at.alias("at"), F.col("policy_decision").alias("decision"), F.col("row_count").alias("rows"))
