import copy

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from checks.relations import CONFIG, home_region
from palisade import AccessDenied, Bundle, GovernedSession, governed_table
from palisade.functions.predicates import equality_filter, typed_predicate
from palisade.operators import enforce, writes
from palisade.plans.governed_sql import QueryRefused


def test_flagship(spark, tables, bundle, sf):
    result = governed_table(spark, tables, bundle, "steward", "warehouse", "customer")
    rows = result.capped().collect()
    assert len(rows) == spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal > 0").count() == 139
    assert {r["c_acctbal"] for r in rows} == {"***REDACTED***"}
    assert all(r["c_name"].startswith("name-") for r in rows)
    assert [m["name"] for m in result.masked] == ["c_name", "c_acctbal"]
    assert result.masked_requested(["C_ACCTBAL", "c_custkey"]) == ["c_acctbal"]
    with pytest.raises(AccessDenied, match="pii-classified"):
        governed_table(spark, tables, bundle, "planner", "warehouse", "customer")


def test_filters_see_raw_values_and_may_use_columns_out_of_scope(spark, tables):
    config = copy.deepcopy(CONFIG)
    rule = config["scopes"][2]["sources"][0]["rules"][0]
    rule["fields"], rule["filters"] = ["c_name"], {"c_custkey": 7}
    bundle = Bundle.from_config(spark, config)
    out = governed_table(spark, tables, bundle, "steward", "warehouse", "customer").df
    assert out.columns == ["c_name"] and out.count() <= 1


def test_missing_scope_field_is_an_error(spark, tables):
    config = copy.deepcopy(CONFIG)
    config["scopes"][0]["sources"][0]["rules"][0]["fields"] = ["o_orderkey", "no_such_column"]
    with pytest.raises(Exception, match="no_such_column"):
        governed_table(
            spark, tables, Bundle.from_config(spark, config), "order-desk", "warehouse", "orders"
        )


def test_residency_needs_a_region_column(spark, tables, bundle, sf):
    with pytest.raises(AccessDenied, match="Residency"):
        governed_table(spark, tables, bundle, "steward", "people_db", "customer")
    key = home_region(spark, sf)
    shown = governed_table(spark, tables, bundle, "steward", "people_db", "customer", residency=key).df
    homes = {r["key"] for r in key.via.filter("region in ('AFRICA', 'ASIA', 'MIDDLE EAST')").collect()}
    assert {r["c_nationkey"] for r in shown.select("c_nationkey").distinct().collect()} <= homes


def test_barrier_gives_the_same_rows(spark, tables, bundle):
    plain = governed_table(spark, tables, bundle, "steward", "warehouse", "customer").df
    walled = governed_table(spark, tables, bundle, "steward", "warehouse", "customer", barrier=True).df
    assert sorted(plain.collect()) == sorted(walled.collect())
    # the raw table is out of the plan, so no expression can reach its filtered rows
    assert "customer.parquet" in plan_of(plain) and "customer.parquet" not in plan_of(walled)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab"), (5, "cd"), (None, None)], "n int, s string")
    for op, value, want in [
        ("eq", 1, [1]), ("neq", 1, [5]), ("gt", 1, [5]), ("gte", 1, [1, 5]), ("lt", 5, [1]), ("lte", 5, [1, 5]),
        ("in", [1, 9], [1]), ("nin", [1], [5]), ("in", [], []), ("nin", [], [1, 5]),
    ]:
        assert [r["n"] for r in df.filter(typed_predicate("n", op, value)).collect()] == want, op
    assert df.filter(typed_predicate("s", "contains", "b")).count() == 1
    with pytest.raises(ValueError):
        typed_predicate("n", "eq", [1])
    with pytest.raises(ValueError):
        typed_predicate("n", "like", "x")
    assert df.filter(equality_filter({"n": None})).count() == 0
    with pytest.raises(ValueError):
        equality_filter({"n": {"$gt": 1}})


def test_plans_stay_in_the_jvm_and_prune(spark, tables, bundle):
    out = governed_table(spark, tables, bundle, "order-desk", "warehouse", "orders").df
    plan = plan_of(out.select("o_orderkey"))
    assert "Python" not in plan
    assert "EqualTo(o_orderstatus,O)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


# ── governed SQL must not leak ─────────────────────────────────────


@pytest.fixture
def session(spark, tables, bundle, sf):
    raw = spark.read.parquet(f"{sf}/customer.parquet")
    raw.createOrReplaceTempView("raw_view")
    raw.createOrReplaceGlobalTempView("raw_global")
    if not spark.catalog.tableExists("raw_table"):
        raw.write.saveAsTable("raw_table")
    spark.sql("CREATE FUNCTION IF NOT EXISTS peek() RETURNS STRING RETURN SELECT max(c_name) FROM default.raw_table")
    return GovernedSession(spark, tables, bundle, "steward", "warehouse")


LEAKS = [
    "SELECT * FROM raw_view",
    "SELECT * FROM raw_table",
    "SELECT * FROM default.raw_table",
    "SELECT * FROM spark_catalog.default.raw_table",
    "SELECT * FROM global_temp.raw_global",
    "SELECT * FROM parquet.`{sf}/customer.parquet`",
    "SELECT * FROM identifier('raw' || '_table')",
    "SELECT identifier('pe' || 'ek')() FROM nation",
    "SELECT identifier('n_' || 'name') FROM nation",
    "SELECT * FROM identifier('range')(10)",
    "SELECT n_name FROM nation WHERE identifier('pe' || 'ek')() IS NOT NULL",
    "SELECT count(*) FROM nation GROUP BY identifier('pe' || 'ek')()",
    "SELECT /*+ BROADCAST(orders) */ * FROM nation JOIN orders ON true",
    "SELECT * FROM nation WHERE 1 IN (SELECT c_custkey FROM raw_table)",
    "SELECT (SELECT max(c_name) FROM raw_table) FROM nation",
    "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM raw_table)",
    "SELECT * FROM nation, LATERAL (SELECT c_name FROM raw_table)",
    "WITH raw_table AS (SELECT * FROM raw_table) SELECT * FROM raw_table",
    "WITH a AS (WITH raw_table AS (SELECT 1) SELECT * FROM raw_table) SELECT * FROM a JOIN raw_table ON true",
    "SELECT * FROM nation UNION SELECT 1, c_name, 2 FROM raw_table",
    "FROM raw_table |> SELECT c_name",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM nation",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT n_name FROM nation ORDER BY try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT row_number() OVER w FROM nation WINDOW w AS (ORDER BY java_method('java.lang.System', 'lineSeparator'))",
    "SELECT input_file_name() FROM nation",
    "SELECT * FROM range(10)",
    "SELECT * FROM nation VERSION AS OF 1",
    "SELECT count(*) OVER w FROM nation WINDOW w AS (PARTITION BY (SELECT max(c_acctbal) FROM raw_table) > 100)",
    "SELECT count(*) OVER w FROM nation WINDOW w AS (PARTITION BY (SELECT max(c_acctbal) FROM global_temp.raw_global))",
    "SELECT sum(1) OVER v FROM nation WINDOW w AS (ORDER BY (SELECT 1 FROM raw_table)), v AS (ORDER BY n_name)",
    "SELECT count(*) FROM nation HAVING count(*) > (SELECT max(c_acctbal) FROM raw_table)",
    "SELECT * FROM nation JOIN region ON n_regionkey = (SELECT max(c_custkey) FROM raw_table)",
    "SELECT n_name FROM nation ORDER BY (SELECT max(c_name) FROM raw_table)",
    "SELECT transform(array(1), x -> x + (SELECT count(*) FROM raw_table)) FROM nation",
    "SELECT TRANSFORM(n_name) USING 'cat' FROM nation",
    "SET spark.sql.runSQLOnFiles=true",
    "INSERT INTO nation VALUES (1, 'x', 2)",
    "CREATE TABLE t AS SELECT * FROM nation",
    "DROP VIEW nation",
    "SHOW TABLES",
    "EXPLAIN SELECT * FROM nation",
    "EXECUTE IMMEDIATE 'SELECT * FROM raw_table'",
    "BEGIN SELECT * FROM raw_table; END",
    "SELECT 1) AS x, (SELECT * FROM raw_table",
    "SELECT * FROM nation; SELECT * FROM raw_table",
    "not sql at all",
]


@pytest.mark.parametrize("query", LEAKS)
def test_refused(session, sf, query):
    with pytest.raises(AccessDenied):
        session.sql(query.replace("{sf}", sf)).collect()


BESIDE = [
    q
    for q in LEAKS
    if q.startswith(("SELECT", "WITH", "FROM")) and any(x in q for x in ("raw", "'pe'", "range", "parquet."))
    if "w AS (ORDER BY (SELECT 1" not in q  # a window that nothing uses is gone after analysis
]


@pytest.mark.parametrize("query", BESIDE)
def test_lineage_alone_refuses_what_reads_beside_the_views(session, sf, query):
    """The second check, on the analysed plan, without the first."""
    from pyspark.errors import AnalysisException, ParseException

    session.register("nation", "customer", "region")
    try:
        found = session.session.sql(query.replace("{sf}", sf))
    except (AnalysisException, ParseException):
        return
    with pytest.raises(QueryRefused, match="beside the governed views"):
        session.check_lineage(found, ["nation", "customer", "region"])


def test_lineage_knows_views_by_what_they_stand_for(spark, session, sf):
    session.register("nation")
    found = session.session.sql("SELECT a.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
    session.check_lineage(found, ["nation"])
    with pytest.raises(QueryRefused):
        session.check_lineage(found, ["region"])
    session.register("customer")
    session.check_lineage(session.session.sql("SELECT * FROM customer"), ["customer"])
    session.session.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("customer")
    with pytest.raises(QueryRefused):
        session.check_lineage(session.session.sql("SELECT * FROM customer"), ["customer"])


@pytest.mark.parametrize("barrier", [False, True])
def test_views_follow_the_files(spark, bundle, sf, tmp_path, barrier):
    from palisade import Registry

    folder = str(tmp_path / "lake")
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    nations.write.parquet(f"{folder}/nation.parquet")
    own = GovernedSession(spark, Registry().add_files("warehouse", folder, ["nation"]), bundle, "map-reader", "warehouse", barrier=barrier)
    assert own.sql("SELECT * FROM nation").count() == 25
    nations.limit(3).write.mode("append").parquet(f"{folder}/nation.parquet")
    assert own.sql("SELECT * FROM nation").count() == 28
    nations.limit(4).write.mode("overwrite").parquet(f"{folder}/nation.parquet")
    assert own.sql("SELECT * FROM nation").count() == 4


def test_hidden_file_column_is_not_visible(session):
    with pytest.raises(Exception, match="_metadata"):
        session.sql("SELECT _metadata.file_path FROM nation").collect()


def test_stored_sql_function_is_refused(spark, session):
    with pytest.raises(QueryRefused, match="peek"):
        session.sql("SELECT peek() FROM nation").collect()


@pytest.mark.parametrize(
    "query",
    [
        "SELECT c_name AS anything FROM customer",
        "SELECT upper(x) FROM (SELECT c_name AS x FROM customer) t",
        "WITH c AS (SELECT * FROM customer) SELECT c.c_name FROM c -- trailing comment",
        "SELECT b.c_name FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey",
        "SELECT max(c_name) OVER (PARTITION BY c_mktsegment) FROM CUSTOMER",
        "FROM customer |> SELECT c_name",
        "SELECT max(c_name) FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())",
    ],
)
def test_masks_hold_under_any_shape(session, query):
    rows = session.sql(query).collect()
    assert rows and all(r[0].lower().startswith("name-") for r in rows)


def test_filtered_rows_and_dropped_columns_are_gone(session, sf, spark):
    poor = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal <= 0")
    assert poor.count() > 0
    hidden = {r["c_custkey"] for r in poor.collect()}
    seen = session.sql("SELECT c_custkey FROM customer").collect()
    assert seen and not hidden & {r[0] for r in seen}
    with pytest.raises(Exception, match="c_nationkey"):
        session.sql("SELECT c_nationkey FROM customer").collect()


def test_cap_is_outermost_and_the_tightest(spark, session):
    config = copy.deepcopy(CONFIG)
    config["governance"]["sourcePolicies"][0]["tables"][0]["maxRows"] = 77
    session.bundle = Bundle.from_config(spark, config)
    assert session.sql("SELECT o_orderkey FROM orders").count() == 600
    assert session.sql("SELECT count(*) FROM orders").first()[0] > 600
    assert session.sql("SELECT o_orderkey FROM orders, customer").count() == 77


def test_barrier_in_sql(spark, tables, bundle, session):
    walled = GovernedSession(spark, tables, bundle, "steward", "warehouse", barrier=True)
    query = "SELECT c_custkey, c_name FROM customer"
    assert walled.sql(query).count() == 139
    assert walled.masked_columns() == {"customer": ["c_name", "c_acctbal"]}
    assert "customer.parquet" not in plan_of(walled.sql(query))


def test_scope_applies_to_each_table(session):
    with pytest.raises(AccessDenied, match="not in scope"):
        session.sql("SELECT * FROM nation JOIN supplier ON true")
    assert session.check("SELECT * FROM nation WHERE n_name IN (SELECT r_name FROM region)") == ["nation", "region"]


def test_tables_in_any_case(session):
    assert session.sql("SELECT N.n_name FROM Nation N JOIN REGION ON n_regionkey = r_regionkey").count() == 25


PLAIN = [
    "SELECT CASE WHEN n_nationkey BETWEEN 1 AND 3 THEN 'a' ELSE n_name END AS x, n_name LIKE 'A%' FROM nation",
    "SELECT * FROM nation WHERE n_name IN ('FRANCE', 'CHINA') AND NOT n_nationkey <=> 3 OR n_name RLIKE '^A'",
    "SELECT cast(n_nationkey AS string) || n_name, -n_nationkey, n_nationkey DIV 2, n_nationkey % 3, ~n_nationkey FROM nation",
    "SELECT extract(YEAR FROM o_orderdate), o_orderdate + INTERVAL 1 DAY, date '1997-01-01' FROM orders",
    "SELECT filter(array(1, 2, 3), x -> x > 1), transform(array(n_name), (x, i) -> concat(x, i)) FROM nation",
    "SELECT sum(n_nationkey) FILTER (WHERE n_regionkey = 1), count(DISTINCT n_name) FROM nation",
    "SELECT n_regionkey, grouping(n_regionkey), count(*) FROM nation GROUP BY ROLLUP (n_regionkey) HAVING count(*) > 1",
    "SELECT min(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM nation",
    "SELECT first_value(n_name) OVER w FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name DESC NULLS LAST)",
    "SELECT struct(n_name AS a).a, map('k', n_name)['k'], array(n_name)[0], named_struct('x', 1).x FROM nation",
    "SELECT x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT explode(array(1, 2)) FROM nation",
    "SELECT trim(BOTH 'x' FROM n_name), substring(n_name FROM 2 FOR 3), position('A' IN n_name), overlay(n_name PLACING 'x' FROM 1) FROM nation",
    "SELECT (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) FROM nation",
    "SELECT * EXCEPT (n_name) FROM nation ORDER BY 1 LIMIT 3 OFFSET 1",
    "SELECT current_date(), current_date, current_timestamp, n_name FROM nation",
    "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)",
    "SELECT n_regionkey, collect_list(n_name) FROM nation GROUP BY ALL ORDER BY ALL",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY n_nationkey) FROM nation",
    "SELECT * FROM nation PIVOT (count(n_name) FOR n_regionkey IN (0, 1))",
    "SELECT n_name IS NOT TRUE OR n_name IS UNKNOWN FROM (SELECT n_regionkey = 1 AS n_name FROM nation)",
    "SELECT n_name FROM nation WHERE n_name LIKE ANY ('A%', 'B%') AND n_name ILIKE 'a%'",
    "SELECT try_cast(n_name AS int), n_name::string FROM nation",
    "SELECT 1 + 2 * 3 - 4 / 5, 1 & 2 | 3 ^ 4, 1 << 2, 8 >> 1 FROM nation",
    "SELECT timestampadd(DAY, 1, o_orderdate), timestampdiff(DAY, o_orderdate, o_orderdate) FROM orders",
]


@pytest.mark.parametrize("query", PLAIN)
def test_plain_queries_run(session, query):
    session.sql(query).collect()


def test_a_scope_taken_away_shuts_its_tables_at_once(spark, tables, bundle):
    from palisade.operators import maintenance

    own = GovernedSession(spark, tables, bundle, "map-reader", "warehouse")
    assert own.sql("SELECT * FROM nation").count() == 25
    own.bundle = maintenance.remove_scope(bundle, "map-reader")[0]
    with pytest.raises(AccessDenied, match="No scope"):
        own.sql("SELECT * FROM nation")
    asked = []
    own = GovernedSession(spark, tables, lambda: asked.append(1) or bundle, "map-reader", "warehouse")
    own.sql("SELECT * FROM nation"), own.sql("SELECT * FROM nation")
    assert len(asked) == 2


def test_sessions_keep_their_own_audit(spark, tables, bundle, tmp_path):
    from palisade.sources.audit_log import read_audit

    path = str(tmp_path / "audit")
    own = GovernedSession(spark, tables, bundle, "map-reader", "warehouse", audit=path)
    assert own.run("SELECT * FROM nation", lambda df: df.collect())["row_count"] == 25
    with pytest.raises(AccessDenied):
        own.sql("SELECT * FROM orders")
    with pytest.raises(ZeroDivisionError):
        own.run("SELECT * FROM region", lambda df: 1 / 0)
    stored = {(r["resource"], r["policy_decision"]) for r in read_audit(spark, path).collect()}
    assert stored == {("nation", "permitted"), ("SELECT * FROM orders", "denied"), ("region", "failed")}


def test_recursive_query(session):
    rows = session.sql(
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r"
    ).collect()
    assert sorted(r[0] for r in rows) == [1, 2, 3, 4]


def test_the_main_session_keeps_its_functions(spark, session):
    assert spark.sql("SELECT java_method('java.lang.Math', 'abs', -3)").first()[0] == "3"


# ── writes ─────────────────────────────────────────────────────────


def access(**options):
    return enforce.Access("a", "s", "t", max_rows=0, requires_approval=False, **options)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "x", "EU"), (2, "y", "US"), (3, None, None)], "id int, name string, r string")


def test_delete_keeps_rows_with_unknown_condition(people):
    left = writes.governed_delete(people, F.col("name") == "x", access())
    assert [r["id"] for r in left.collect()] == [2, 3]


def test_update_within_reach_only(people):
    own = access(row_filter="r = 'EU'", fields=["name"])
    out = writes.governed_update(people, {"name": F.lit("z")}, F.lit(True), own)
    assert [r["name"] for r in out.collect()] == ["z", "y", None]
    with pytest.raises(AccessDenied, match="outside the scope"):
        writes.governed_update(people, {"r": F.lit("EU")}, F.lit(True), own)


def test_update_by_residency(spark, people):
    via = spark.createDataFrame([("EU", "europe"), ("US", "america")], "key string, region string")
    own = access(residency=["europe"])
    key = enforce.ResidencyKey("r", via)
    out = writes.governed_update(people, {"name": F.lit("z")}, F.lit(True), own, residency=key)
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "z", 2: "y", 3: None}
    with pytest.raises(AccessDenied):
        writes.governed_delete(people, F.lit(True), own)


def test_insert_must_be_readable_back(spark, people):
    rows = spark.createDataFrame([(7, "EU"), (8, "US")], "id int, r string")
    out = writes.governed_insert(people, rows, access(filters={"r": "EU"}))
    assert [tuple(r) for r in out.accepted.collect()] == [(7, None, "EU")]
    assert [tuple(r) for r in out.rejected.collect()] == [(8, None, "US")]


def test_update_may_not_move_rows_out_of_reach(people):
    own = access(row_filter="r = 'EU'")
    with pytest.raises(Exception, match="out of the agent's reach"):
        writes.governed_update(people, {"r": F.lit("US")}, F.lit(True), own).collect()
    out = writes.governed_update(people, {"r": F.lit("EU")}, F.lit(True), own)
    assert [r["r"] for r in out.collect()] == ["EU", "US", None]


def test_writes_do_not_read_masked_columns(people):
    own = access(columns=[{"name": "NAME", "masking": "redact", "classification": "pii"}])
    for assign, where in [({"r": F.col("name")}, F.lit(True)), ({"r": F.lit("EU")}, F.upper("Name") == "X")]:
        with pytest.raises(AccessDenied, match="Masked columns"):
            writes.governed_update(people, assign, where, own)
    with pytest.raises(AccessDenied, match="Masked columns"):
        writes.governed_delete(people, F.col("name").isNull(), own)
    with pytest.raises(AccessDenied, match="outside the scope"):
        writes.governed_delete(people, F.col("name") == "x", access(fields=["id"]))
    assert writes.governed_update(people, {"name": F.lit("z")}, F.col("id") == 1, own).first()["name"] == "z"


def test_approval(people):
    gated = enforce.Access("a", "s", "t", max_rows=0, requires_approval=True)
    with pytest.raises(AccessDenied, match="requires approval"):
        writes.governed_delete(people, F.lit(True), gated)
    assert writes.governed_delete(people, F.lit(True), gated, approved=True).count() == 0
    spark = people.sparkSession
    for row, granted in [(("a", "s", "T", "DELETE"), True), (("a", "s", "t", "UPDATE"), False), (("b", "s", "t", "DELETE"), False)]:
        table = spark.createDataFrame([row], "agent string, source string, table string, operation string")
        if granted:
            assert writes.governed_delete(people, F.lit(True), gated, approved=table).count() == 0
        else:
            with pytest.raises(AccessDenied, match="requires approval"):
                writes.governed_delete(people, F.lit(True), gated, approved=table)


def test_only_touched_partitions_are_rewritten(spark, people, tmp_path):
    path = str(tmp_path / "t")
    people.na.fill("none", ["r"]).write.partitionBy("r").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "r=US").glob("*.parquet")}
    table = spark.read.schema(people.schema).parquet(path)
    where = F.col("id") == 1
    change = lambda rows: writes.governed_update(rows, {"name": F.lit("new")}, where, access())
    writes.rewrite_partitions(table, where, change, path, ["r"])
    assert {r["id"]: r["name"] for r in spark.read.parquet(path).collect()} == {1: "new", 2: "y", 3: None}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "r=US").glob("*.parquet")} == before


def stored_by(spark, rows, path):
    df = spark.createDataFrame(rows, "id int, p int")
    df.write.partitionBy("p").parquet(path)
    return lambda: spark.read.schema(df.schema).parquet(path)


def states(read):
    return sorted((r["id"], r["p"]) for r in read().collect())


def test_rows_move_between_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    read = stored_by(spark, [(1, 3), (2, 3), (3, 5), (4, 5), (5, 7), (6, None)], path)
    where = F.col("p") == 3
    change = lambda rows: writes.governed_update(rows, {"p": F.lit(5)}, where, access())
    writes.rewrite_partitions(read(), where, change, path, ["p"])
    assert sorted(((r["id"], r["p"]) for r in read().collect()), key=str) == sorted(
        [(1, 5), (2, 5), (3, 5), (4, 5), (5, 7), (6, None)], key=str
    )


def test_a_delete_empties_partitions_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    read = stored_by(spark, [(1, 3), (2, 3), (3, 5), (4, 7)], path)
    where = (F.col("p") == 3) | (F.col("id") == 9)
    change = lambda rows: writes.governed_delete(rows, where, access())
    writes.rewrite_partitions(read(), where, change, path, ["p"])
    assert states(read) == [(3, 5), (4, 7)]
    writes.rewrite_partitions(read(), F.col("id") == 99, change, path, ["p"])  # nothing to do
    assert states(read) == [(3, 5), (4, 7)]


@pytest.mark.parametrize("listed", ["1, 5", "1, NULL", "NULL", None])
def test_not_in_is_not_gathered_in_the_driver(spark, session, listed):
    """NOT IN over a list of any size is an anti join that shuffles, with SQL's rules for NULLs on either side."""
    session.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = f"(VALUES ({listed.replace(', ', '), (')})) v(k)" if listed else "(SELECT 1 AS k) v WHERE k > 1"
    query = f"""SELECT n FROM (SELECT nullif(n_nationkey, 3) AS n FROM (VALUES 0, 1, 3, 5) t(n_nationkey)) o
WHERE (n) NOT IN (SELECT CAST(k AS int) FROM {rows} -- the list
) AND NOT coalesce(n, 0) IN (SELECT 9)"""
    got = session.sql(query)
    want = {"1, 5": [0], "1, NULL": [], "NULL": [], None: [None, 0, 1, 5]}[listed]
    assert sorted((r["n"] for r in got.collect()), key=lambda n: (n is not None, n)) == want
    plan = plan_of(session.sql("SELECT count(*) FROM orders o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"))
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan


def test_lists_that_hang_on_order_or_chance_are_asked_once(session):
    for query in (
        "SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region LIMIT 2)",
        "SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) OR n_name = 'x'",
        "SELECT 1 FROM nation WHERE (SELECT 1) NOT IN (SELECT r_regionkey FROM region)",
    ):
        assert session._shuffled(query) == query
    chance = session.sql("SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT CAST(rand() * 9 AS int) FROM region)")
    assert "EXISTS" not in chance._jdf.queryExecution().analyzed().toString().upper()
