"""Policy maintenance, view catalog, and plan shapes at scale."""

import copy

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from checks.relations import CONFIG, big_bundle, big_requests, requests, table
from palisade import Bundle
from palisade.operators import decisions, lookups, maintenance, scope, viewcatalog
from palisade.operators.vault import detokenize, token_vault
from palisade.plans.outcome import request_outcome
from palisade.sources.config import ConfigError

SCOPE = {"agent": "map-reader", "sources": [{"name": "people_db", "rules": [{"table": "t"}]}]}


def agents(bundle):
    return [r["agent"] for r in bundle.scope_rules.groupBy("agent").agg(F.min("scope_pos").alias("p")).orderBy("p").collect()]


def test_set_scope_replaces_in_place_or_appends(bundle):
    order = agents(bundle)
    changed = maintenance.set_scope(bundle, SCOPE)
    assert agents(changed) == order
    rows = changed.scope_rules.filter("agent = 'map-reader'").collect()
    assert [(r["source"], r["table"]) for r in rows] == [("people_db", "t")]
    added = maintenance.set_scope(bundle, {**SCOPE, "agent": "new"})
    assert agents(added) == [*order, "new"]
    assert agents(bundle) == order  # the old bundle is as it was
    with pytest.raises(ConfigError, match="At least one source"):
        maintenance.set_scope(bundle, {"agent": "a", "sources": []})


def test_changes_reach_the_next_decision(spark, bundle):
    changed = maintenance.set_scope(bundle, SCOPE)
    df = spark.createDataFrame([("map-reader", "warehouse", "nation")], "agent string, source string, table string")
    assert scope.scope_decision(df, bundle).first()["scope"]["permitted"]
    assert not scope.scope_decision(df, changed).first()["scope"]["permitted"]


def test_remove_scope(bundle):
    left, found = maintenance.remove_scope(bundle, "map-reader")
    assert found and "map-reader" not in agents(left)
    assert maintenance.remove_scope(left, "map-reader")[1] is False


def test_sources(bundle):
    new = {"name": "n", "type": "rest", "connection": {"url": "u"}, "credentials": {"apiKey": "k"}}
    more = maintenance.add_source(bundle, new)
    assert [r["name"] for r in more.sources.orderBy("pos").collect()][-1] == "n"
    assert "apiKey" not in str(more.sources.collect())
    with pytest.raises(ValueError, match="Duplicate"):
        maintenance.add_source(more, new)
    with pytest.raises(ConfigError):
        maintenance.add_source(bundle, {**new, "type": "oracle"})
    left, found = maintenance.remove_source(more, "n")
    assert found and left.sources.count() == 5
    assert maintenance.remove_source(left, "n")[1] is False


def test_clean_policies_have_no_violations(bundle):
    assert maintenance.policy_violations(bundle).count() == 0


def test_coverage(spark, bundle):
    catalog = spark.createDataFrame([("warehouse", "part"), ("warehouse", "orders")], "source string, table string")
    assert [r["table"] for r in maintenance.tables_without_policy(catalog, bundle).collect()] == ["part"]
    assert [r["agent"] for r in maintenance.agents_without_policy(bundle).collect()] == ["map-reader"]
    assert maintenance.agents_without_scope(bundle).count() == 0
    assert maintenance.agents_covered(bundle).count() == 3


# ── views ──────────────────────────────────────────────────────────


def views_of(spark, scopes, governance=None):
    config = copy.deepcopy(CONFIG)
    config["scopes"] = scopes
    config["governance"] = governance or {}
    bundle = Bundle.from_config(spark, config)
    return viewcatalog.view_rows(bundle), bundle


def rule_scope(agent, *rules, source="warehouse"):
    return {"agent": agent, "sources": [{"name": source, "rules": list(rules)}]}


def test_view_rows(spark):
    rule = {"table": "shipments", "fields": ["box", "port"], "filters": {"state": "late", "n": 1}}
    cap = {"sourcePolicies": [{"source": "warehouse", "tables": [
        {"table": "shipments", "classification": "internal", "maxRows": 35}]}]}
    views, bundle = views_of(
        spark,
        [
            rule_scope("Dock.Hand", rule, {"table": "shipments"}, {"fields": ["*"]}),
            rule_scope("b", {"table": "x"}, source="feed_api"),
            rule_scope("c", {"table": "y"}),
        ],
        cap,
    )
    rows = {r["name"]: r for r in views.collect()}
    assert set(rows) == {
        "query_warehouse_shipments_dock_hand",
        "query_warehouse___dock_hand",
        "query_warehouse_y_c",
    }
    first = rows["query_warehouse_shipments_dock_hand"]
    assert first["statement"] == "SELECT box, port FROM shipments WHERE state = $1 AND n = $2"
    assert first["type"] == "alloydb-sql" and first["max_rows"] == 35
    wild = rows["query_warehouse___dock_hand"]
    assert wild["statement"] == "SELECT * FROM {{.table}}" and wild["parameters"] == ["agent", "table"]
    assert rows["query_warehouse_y_c"]["max_rows"] is None
    lists = viewcatalog.group_lists(viewcatalog.view_groups(views)).collect()
    assert [(r["name"], len(r["views"])) for r in lists] == [("warehouse_tools", 3)]
    assert viewcatalog.has_database_sources(bundle).first()[0] is True
    stored = viewcatalog.view_rows(bundle.with_tables())
    assert viewcatalog.group_lists(viewcatalog.view_groups(stored)).collect() == lists


# ── plans ──────────────────────────────────────────────────────────


def test_small_policies_do_not_move_requests(spark, sf, bundle):
    plan = plan_of(request_outcome(requests(spark, sf), bundle))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_policies_of_unknown_size_are_not_broadcast_by_force(spark, sf):
    """With automatic broadcasts off, no hint brings one back."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bundle = big_bundle(spark, sf)
        asked = big_requests(spark, sf)
        for df in (decisions.decide(asked, bundle), scope.scope_decision(asked, bundle)):
            plan = plan_of(df)
            assert "BroadcastHashJoin" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
            assert "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_match_keeps_one_row_per_key_before_the_shuffle(spark, sf):
    plan = plan_of(lookups.agent_lookup(big_bundle(spark, sf)))
    assert "row_number(), 1, Partial" in plan


@pytest.fixture
def small_skew(spark):
    """Thresholds at which a test's data count as large and skewed."""
    keys = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_column(name):
    """A third of all rows share one value."""
    return F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias(name)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_token_is_split_over_tasks(spark, small_skew):
    rows = spark.range(0, 200_000, 1, 8).select(hot_column("v"), "id")
    vault = token_vault(rows, ["v"])
    hidden = rows.select(F.concat(F.lit("tok_"), F.substring(F.sha2("v", 256), 1, 12)).alias("v"), "id")
    out = detokenize(hidden, "v", vault)
    assert tuple(out.agg(F.count("*"), F.count_if(F.col("v") == "hot")).first()) == (200_000, 66_667)
    assert "skew=true" in final_plan(out)


@pytest.mark.parametrize("ahead", [False, True])
def test_hot_agent_is_split_over_tasks(spark, small_skew, ahead):
    """Also when the policy side is grouped by the very key it is joined on."""
    agents = spark.range(20_000).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("agent"),
        F.array(F.lit("pii")).alias("allowed_classes"),
        F.lit(9).cast("bigint").alias("max_rows"),
        F.lit(1).cast("bigint").alias("max_concurrency"),
        F.lit(1).cast("bigint").alias("timeout_ms"),
        F.array(F.lit("SELECT")).alias("allowed_ops"),
        F.lit(False).alias("approve_writes"),
        F.lit(None).cast("array<string>").alias("allowed_sources"),
    )
    bundle = Bundle.from_tables(spark, agent_policy=agents)
    asked = spark.range(0, 200_000, 1, 8).select(
        "id", hot_column("agent"), F.lit("s").alias("source"), F.lit("t").alias("table"),
        F.lit("SELECT").alias("operation"),
    )
    out = decisions.decide(asked, lookups.resolve(bundle) if ahead else bundle).select("id", "agent", "decision.max_rows")
    assert out.filter("agent = 'hot'").agg(F.count("*"), F.max("max_rows")).first() == (66_667, 9)
    assert "skew=true" in final_plan(out)


def test_hot_scope_is_split_over_tasks(spark, small_skew):
    rules = spark.range(0, 200_000, 1, 8).select(
        (F.col("id") % 1).alias("scope_pos"), (F.col("id") % 1).alias("source_pos"),
        F.col("id").alias("rule_pos"), hot_column("agent"), (F.col("id") % 2).cast("string").alias("source"),
        F.col("id").cast("string").alias("table"), F.array(F.lit("f")).alias("fields"),
        F.lit(None).cast("array<struct<key:string,value:string,type:string>>").alias("filters"),
    )
    out = scope.active_rules(Bundle.from_tables(spark, scope_rules=rules))
    assert out.count() == 200_000
    assert "skew=true" in final_plan(out)


def exchanges(df) -> list[str]:
    import re

    plan = plan_of(df).split("== Initial Plan ==")[0]
    return re.findall(r"Exchange (?:hash|range|single)\w*", plan)


def test_a_stored_vault_does_not_move(spark, small_skew):
    rows = spark.range(0, 5000, 1, 4).select(F.col("id").cast("string").alias("v"), "id")
    from palisade.operators.vault import store_vault

    vault = store_vault(token_vault(rows, ["v"]))
    hidden = rows.select(F.concat(F.lit("tok_"), F.substring(F.sha2("v", 256), 1, 12)).alias("v"), "id")
    out = detokenize(hidden, "v", vault, stored=True)
    assert sorted(map(tuple, out.collect())) == sorted((str(i), i) for i in range(5000))
    assert len(exchanges(out)) == 1  # of the rows that get their values back
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vault")]


def test_scopes_are_resolved_once_and_the_log_moves_twice(spark, sf, small_skew):
    bundle = big_bundle(spark, sf)
    out = scope.scope_decision(big_requests(spark, sf), bundle)
    assert plan_of(out).count("orders.parquet") <= 2  # the log's own orders, on both sides of the fold: no rule is read again
    resolved = scope.resolve_scopes(bundle)
    assert scope.resolve_scopes(resolved) is resolved
    assert sorted(resolved.resolved) == ["entries", "merged"]


def test_access_matrix_folds_once(spark, sf, small_skew):
    out = decisions.access_matrix(big_requests(spark, sf), lookups.resolve(big_bundle(spark, sf)))
    assert plan_of(out).count("HashAggregate(keys=[agent") <= 2


def test_no_registered_query_uses_python_or_cross_joins(spark, sf):
    from checks import masks, trail, verdicts  # noqa: F401  (registration)
    from checks.relations import QUERIES

    for name in ("governance_decision", "scope_decision_large", "parse_free_text", "mask_hash_compat", "view_rows"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name


def test_scans_read_only_the_needed_columns(spark, sf, bundle):
    df = decisions.decide(
        table(spark, sf, "events").selectExpr(
            "event_id AS request_id", "'map-reader' AS agent", "'warehouse' AS source", "event_type AS table", "'SELECT' AS operation"
        ),
        bundle,
    ).select("decision.allowed")
    reads = plan_of(df).split("ReadSchema")[1]
    assert "event_type" in reads and "props" not in reads and "value" not in reads
