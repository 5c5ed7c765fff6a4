"""Policies as of the time of a request; as-of lookups over ranges; what-if by what a change touches."""

import copy
import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from checks.relations import CONFIG, parsed_requests, small_bundle
from palisade import Bundle
from palisade.operators import decisions, history
from palisade.operators.prefix import as_of
from palisade.streaming import streams

NOW = datetime(2024, 1, 1)


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_as_of_against_brute_force(spark, pieces):
    """Ties in time, keys without versions, NULL keys and times, one key with most rows, repeated rows."""
    rng = random.Random(pieces)
    versions = {(rng.choice("abcd"), rng.randint(0, 50)): k for k in range(40)}
    asked = [(k, rng.choice(["a"] * 20 + ["b", "c", "x", None]), None if k % 40 == 7 else rng.choice([5, rng.randint(-3, 60)])) for k in range(500)]
    asked += asked[:25]
    right = spark.createDataFrame([(key, t, (v,)) for (key, t), v in versions.items()] + [(None, 1, (99,))], "key string, since int, value struct<v:int>")
    left = spark.createDataFrame(asked, "id int, key string, t int")
    got = as_of(left, right, ["key"], "t", "since", "value", "found", pieces)
    want = Counter()
    for k, key, t in asked:
        begun = [s for (name, s) in versions if name == key and t is not None and s <= t]
        want[k, key, t, versions[key, max(begun)] if begun else None] += 1
    assert got.columns == ["id", "key", "t", "found"]
    assert Counter((r.id, r.key, r.t, r.found and r.found.v) for r in got.collect()) == want
    assert as_of(left.limit(0), right, ["key"], "t", "since", "value", "found", pieces).collect() == []
    assert as_of(left, right.limit(0), ["key"], "t", "since", "value", "found", pieces).where("found is not null").count() == 0


def bundles(spark):
    """Five policy sets: agents, tables and the default policy come, change and go."""
    out = []
    for k in range(5):
        config = copy.deepcopy(CONFIG)
        g = config["governance"]
        if k % 2:
            g["agentPolicies"] = g["agentPolicies"][1:]
            g["sourcePolicies"][0]["tables"][0]["columns"][0]["masking"] = "hash"
        if k >= 2:
            g["agentPolicies"][-1]["maxRowsPerQuery"] = 7 + k
            g["sourcePolicies"] = g["sourcePolicies"][:1]
        if k == 3:
            g["defaultAgentPolicy"] = {"agent": "*", "allowedOperations": ["SELECT", "DELETE"], "maxRowsPerQuery": 3}
        out.append((NOW + timedelta(days=3 * k + 1), replace(Bundle.from_config(spark, config), enabled=k != 4)))
    return out


def judged(df):
    return {r.request_id: r.decision for r in df.select("request_id", "decision").collect()}


@pytest.fixture(scope="module")
def case(spark, sf):
    versions = bundles(spark)
    asked = parsed_requests(spark, sf).withColumn("ts", F.lit(NOW) + F.make_dt_interval(F.col("request_id") % 16, F.col("request_id") % 2 * 24))
    asked = asked.withColumn("ts", F.when(F.col("request_id") % 90 != 0, F.col("ts")))
    nothing = Bundle.from_config(spark, {**CONFIG, "governance": {}, "scopes": []})
    want = {}
    for k, bundle in enumerate([nothing, *[b for _, b in versions]]):
        start = versions[k - 1][0] if k else datetime(1900, 1, 1)
        end = versions[k][0] if k < len(versions) else datetime(2200, 1, 1)
        own = asked.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
        want |= judged(decisions.decide(own if k else own.unionByName(asked.where("ts is null")), bundle))
    return versions, asked, want


def test_each_request_by_the_policies_of_its_time(spark, case):
    versions, asked, want = case
    past = history.PolicyHistory.from_versions(spark, versions)
    assert past.small and judged(history.decide_as_of(asked, past)) == want
    assert "Exchange hashpartitioning(agent" not in plan_of(history.decide_as_of(asked.drop("columns"), past)).split("Scan parquet")[0]
    large = history.PolicyHistory.from_versions(spark, [(t, b.with_tables()) for t, b in versions])
    assert not large.small and judged(history.decide_as_of(asked, large)) == want
    with pytest.raises(ValueError):
        history.PolicyHistory.from_versions(spark, versions[::-1])


@pytest.mark.parametrize("listed", [0, 16])
def test_short_histories_join_as_lists_long_ones_by_ranges(spark, case, monkeypatch, listed):
    versions, asked, want = case
    monkeypatch.setattr(history, "LISTED", listed)
    large = history.PolicyHistory.from_versions(spark, [(t, b.with_tables()) for t, b in versions])
    got = history.decide_as_of(asked, large)
    assert judged(got) == want
    assert ("/asof-" in plan_of(got)) == (not listed)  # only ranges store the requests


def test_a_history_grows_by_what_changes(spark, case, tmp_path):
    versions, asked, want = case
    past = history.PolicyHistory.from_versions(spark, versions[:1])
    for k, (start, bundle) in enumerate(versions[1:]):
        rows = past.tables.count()
        past = past.extended(start, bundle)
        assert k or past.tables.count() == rows + 1  # one table's masks change
        past.write(str(tmp_path / str(k)))
        past = history.PolicyHistory.read(spark, str(tmp_path / str(k)))
    assert judged(history.decide_as_of(asked, past)) == want
    with pytest.raises(ValueError):
        past.extended(versions[0][0], versions[0][1])


def test_stated_ends(spark):
    past = history.PolicyHistory.from_versions(spark, bundles(spark)[:1])
    past = replace(past, agents=past.agents.withColumn("valid_to", F.lit(NOW + timedelta(days=2)).cast("timestamp_ntz")))
    asked = spark.createDataFrame([(d, "steward", "warehouse", "nation", "SELECT", NOW + timedelta(days=d)) for d in (0, 1, 2, 3)], "request_id int, agent string, source string, table string, operation string, ts timestamp_ntz")
    for form in (past, replace(past, small=False)):
        caps = {k: d.max_rows for k, d in judged(history.decide_as_of(asked, form)).items()}
        assert caps == {0: 0, 1: 3200, 2: 100, 3: 100}  # before: refused; then the agent's own cap, then the default one


def test_stream_decisions_as_of(spark, case, tmp_path):
    versions, asked, want = case
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, past in (("small", versions), ("large", [(t, b.with_tables()) for t, b in versions])):
        past = history.PolicyHistory.from_versions(spark, past)
        stream = streams.stream_files(spark, str(tmp_path / "in"), asked.schema, maxFilesPerTrigger=1)
        out = history.decide_as_of(stream, past)
        streams.drain(streams.run_to_files(out, str(tmp_path / name), str(tmp_path / f"{name}-at"), availableNow=True))
        assert judged(spark.read.parquet(str(tmp_path / name))) == want


def test_what_if_judges_what_the_change_touches(spark, sf):
    asked, before = parsed_requests(spark, sf), small_bundle(spark)
    keys = ["agent", "source", "table", "operation", "columns"]
    distinct = asked.select(*keys).distinct()
    for k, (_, after) in enumerate(bundles(spark)):
        for a, b in ((before, after), (before.with_tables(), after.with_tables())):
            got, want = (Counter(map(str, f(asked, a, b).collect())) for f in (decisions.what_if_touched, decisions.what_if))
            assert got == want
            touched = decisions.touched_by(distinct, a, b).count()
            assert (touched == 0) == (k == 0) and (touched < distinct.count() or k == 4)
