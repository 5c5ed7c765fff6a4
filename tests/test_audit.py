import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import audit as trail
from palisade.operators.enforce import governed_table
from palisade.operators.prefix import running_sum
from palisade.sources.audit_log import AUDIT_SCHEMA, append_audit, read_audit
from palisade.sources.policy import local_frame

START = datetime(2024, 1, 1)


def entries(spark, rows):
    base = {"source": "s", "action": "QUERY", "resource": "t", "policy_decision": "permitted"}
    return local_frame(spark, [{**base, **r} for r in rows], AUDIT_SCHEMA)


def log_of(n, seed=0, spread=600):
    """Agent ``hot`` holds a third of all rows and many of them share one instant."""
    rng = random.Random(seed)
    return [
        {
            "seq": i,
            "agent_id": "hot" if i % 3 == 0 else f"a{rng.randint(0, 5)}",
            "timestamp": START + timedelta(milliseconds=0 if i % 6 == 0 else rng.randint(0, spread * 1000)),
            "row_count": rng.choice([None, 1, 7, 30]),
            "duration_ms": rng.choice([None, 0, 5, 900, 70_000]),
        }
        for i in range(n)
    ]


def test_newest_first_over_live_and_batch_entries(spark):
    log = entries(spark, [{"seq": 10**15 + i if i % 2 else i, "agent_id": "a", "timestamp": START + timedelta(seconds=i // 3)} for i in range(30)] + [{"seq": 10**16, "agent_id": "a"}])
    got = [(r["timestamp"], r["seq"]) for r in trail.view_audit(log, limit=31).collect()]
    assert got == sorted(got[:-1], reverse=True) + [(None, 10**16)]


@pytest.mark.parametrize("pieces", [None, 1, 7])
def test_sliding_rates_against_brute_force(spark, pieces):
    """One agent with most entries, entries of one instant, and distances of exactly the length."""
    rng = random.Random(3)
    rows = [{"seq": i, "agent_id": rng.choice(["hot"] * 8 + ["b", "c"]), "timestamp": START + timedelta(seconds=rng.choice([0, 60, 120, rng.randint(0, 400)]))} for i in range(700)]
    got = {r["seq"]: r["in_window"] for r in trail.sliding_rates(entries(spark, rows + [{"seq": -1, "agent_id": "b"}, {"seq": -2, "timestamp": START}]), pieces=pieces).collect()}
    want = {}
    for r in rows:
        at = (r["timestamp"], r["seq"])
        want[r["seq"]] = sum(1 for o in rows if o["agent_id"] == r["agent_id"] and (o["timestamp"], o["seq"]) <= at and o["timestamp"] > r["timestamp"] - timedelta(seconds=60))
    assert got == want
    over = {r["seq"] for r in trail.sliding_limit_breaches(entries(spark, rows), 40, pieces=pieces).collect()}
    assert over == {s for s, n in want.items() if n > 40} and over


def test_sketches_merge_to_the_exact_answers(spark):
    rng = random.Random(1)
    rows = [{"seq": i, "agent_id": "ab"[i % 2], "resource": f"t{rng.randint(0, 2999)}", "timestamp": START + timedelta(minutes=rng.randint(0, 9000)), "duration_ms": None if i % 9 == 0 else rng.randint(0, 10**6)} for i in range(20_000)]
    sketches = trail.usage_sketches(entries(spark, rows + [{"seq": -1, "agent_id": "c", "timestamp": START, "resource": "x"}]))
    for r in trail.usage_of_sketches(sketches, "agent_id").collect():
        own = [x for x in rows if x["agent_id"] == r["agent_id"]]
        if r["agent_id"] == "c":
            assert (r["requests"], r["resources"], r["ms_p50"], r["ms_p99"]) == (1, 1, None, None)
            continue
        distinct, times = len({x["resource"] for x in own}), sorted(x["duration_ms"] for x in own if x["duration_ms"] is not None)
        assert r["requests"] == len(own) and abs(r["resources"] / distinct - 1) < 0.05
        for name, rank in (("ms_p50", 0.5), ("ms_p99", 0.99)):
            assert abs(sum(t <= r[name] for t in times) / len(times) - rank) < 0.03
    assert trail.usage_of_sketches(sketches).first()["requests"] == 20_001


def test_audited_run(spark, tables, bundle, tmp_path):
    path = str(tmp_path / "audit")
    result = governed_table(spark, tables, bundle, "steward", "warehouse", "customer")
    entry = trail.run_audited(result, lambda df: df.write.parquet(str(tmp_path / "out")), path)
    assert entry["row_count"] == spark.read.parquet(str(tmp_path / "out")).count() == 139
    stored = read_audit(spark, path).collect()
    assert len(stored) == 1 and stored[0]["policy_decision"] == "permitted" and stored[0]["duration_ms"] >= 0


def test_failures_and_denials_leave_a_record(spark, tables, bundle, tmp_path):
    path = str(tmp_path / "audit")
    result = governed_table(spark, tables, bundle, "steward", "warehouse", "customer")

    def fail(df):
        raise RuntimeError("sink down")

    with pytest.raises(RuntimeError):
        trail.run_audited(result, fail, path)
    trail.log_denial(spark, "map-reader", "warehouse", "orders", path)
    stored = {r["agent_id"]: r for r in read_audit(spark, path).collect()}
    assert stored["steward"]["row_count"] is None
    assert stored["map-reader"]["policy_decision"] == "denied"


def test_append_only_and_microseconds(spark, tmp_path):
    path = str(tmp_path / "audit")
    when = datetime(2024, 5, 1, 1, 2, 3, 456789)
    append_audit(entries(spark, [{"seq": 1, "agent_id": "a", "timestamp": when}]), path)
    first = read_audit(spark, path)
    assert first.first()["timestamp"] == when
    append_audit(entries(spark, [{"seq": 2, "agent_id": "b", "timestamp": when}]), path)
    assert read_audit(spark, path).count() == 2


def test_view(spark):
    log = entries(spark, [{"seq": i, "agent_id": "ab"[i % 2], "timestamp": START} for i in range(25)])
    assert [r["seq"] for r in trail.view_audit(log).collect()] == list(range(24, 4, -1))
    assert [r["seq"] for r in trail.view_audit(log, "a", 3).collect()] == [24, 22, 20]
    assert trail.view_audit(log, limit=0).count() == 1


def test_retention_splits_the_trail(spark):
    log = entries(
        spark, [{"seq": i, "agent_id": "a", "timestamp": START + timedelta(days=i)} for i in range(10)]
    )
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    kept, gone = trail.retained(log, as_of, 4), trail.expired(log, as_of, 4)
    assert sorted(r["seq"] for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert sorted(r["seq"] for r in gone.collect()) == [0, 1, 2, 3, 4]


def brute_peaks(rows):
    steps = defaultdict(list)
    for r in rows:
        if r["duration_ms"]:
            steps[r["agent_id"]].append((r["timestamp"], 1))
            steps[r["agent_id"]].append((r["timestamp"] + timedelta(milliseconds=r["duration_ms"]), -1))
    peaks = {}
    for agent, found in steps.items():
        level = peaks[agent] = 0
        for _, step in sorted(found):  # an end sorts before a start of the same instant
            level += step
            peaks[agent] = max(peaks[agent], level)
    return peaks


def test_peak_concurrency_against_brute_force(spark, bundle):
    rows = log_of(900)
    got = trail.peak_concurrency(entries(spark, rows), bundle).collect()
    assert {r["agent_id"]: r["peak"] for r in got} == brute_peaks(rows)
    assert all(r["max_concurrency"] == 1 and r["breached"] == (r["peak"] > 1) for r in got)


def test_touching_runs_do_not_overlap(spark, bundle):
    rows = [
        {"seq": i, "agent_id": "a", "timestamp": START + timedelta(milliseconds=100 * i), "duration_ms": 100}
        for i in range(5)
    ]
    assert trail.peak_concurrency(entries(spark, rows), bundle).first()["peak"] == 1


def test_running_sum_over_ranges(spark):
    rows = [r for r in log_of(600) if r["row_count"] is not None]
    rows[5]["agent_id"] = None
    got = running_sum(entries(spark, rows), ["agent_id"], "timestamp", ["seq"], "row_count", "so_far", pieces=5)
    want, level = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
        level[r["agent_id"]] += r["row_count"]
        want[r["seq"]] = level[r["agent_id"]]
    assert {r["seq"]: r["so_far"] for r in got.collect()} == want


def test_ranges_split_a_hot_key(spark):
    """In the range form no (key, range) group holds more than a fraction of the hot key."""
    rows = [{"seq": i, "agent_id": "hot", "timestamp": START, "row_count": 1} for i in range(4000)]
    df = entries(spark, rows).repartitionByRange(8, "agent_id", "timestamp", "seq")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200


def test_row_quota(spark, bundle):
    rows = [
        {"seq": i, "agent_id": "stranger", "timestamp": START + timedelta(minutes=20 * i), "row_count": 40}
        for i in range(6)
    ]
    got = trail.row_quota(entries(spark, rows), bundle).collect()
    assert sorted((r["seq"], r["rows_so_far"], r["max_rows"]) for r in got) == [(2, 120, 100), (5, 120, 100)]


def test_rate_limit(spark):
    rows = [{"seq": i, "agent_id": "a", "timestamp": START + timedelta(seconds=i / 3)} for i in range(400)]
    got = trail.rate_limit_breaches(entries(spark, rows)).collect()
    assert sorted((r["window_start"].minute, r["requests"]) for r in got) == [(0, 180), (1, 180)]


def test_rollup_totals(spark):
    log = entries(spark, log_of(90))
    top = trail.access_rollup(log).filter("level = 7").first()
    assert top["requests"] == 90 and top["agent_id"] is None
    assert trail.access_cube(log).filter("level = 7").first()["requests"] == 90


def test_health(spark, bundle):
    assert tuple(trail.health_counts(bundle).first()) == (5, 4)
