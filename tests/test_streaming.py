import random
from datetime import datetime, timedelta

import pandas as pd

from palisade.operators import audit as trail
from palisade.operators.enforce import check_access, governed_table
from palisade.plans.outcome import request_outcome
from palisade.sources.audit_log import AUDIT_SCHEMA, append_audit_stream, read_audit, stream_audit
from palisade.sources.policy import local_frame
from palisade.sources.snapshots import SnapshotTable
from palisade.streaming import streams

START = datetime(2024, 1, 1)


def land(spark, rows, folder, part):
    base = {"source": "s", "action": "QUERY", "resource": "t", "policy_decision": "permitted"}
    frame = local_frame(spark, [{**base, **r} for r in rows], AUDIT_SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")


def drained(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    streams.drain(streams.run_to_files(df, path, str(tmp_path / f"{name}-state"), availableNow=True))
    return spark.read.schema(df.schema).parquet(path)


def windows(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    query = streams.run_to_windows(df, path, str(tmp_path / f"{name}-state"), availableNow=True)
    streams.drain(query)
    return streams.read_windows(spark, path, df.schema), query


def test_late_rows_are_counted_and_open_windows_delivered(spark, bundle, tmp_path):
    folder = str(tmp_path / "log")

    def at(minutes, seq):
        return {"seq": seq, "agent_id": "a", "timestamp": START + timedelta(minutes=minutes), "row_count": 60}

    land(spark, [at(0, 1), at(1, 2)], folder, 0)
    land(spark, [at(200, 3)], folder, 1)
    land(spark, [at(201, 4)], folder, 2)
    land(spark, [at(2, 5), at(202, 6)], folder, 3)  # minute 2 is later than the watermark allows
    stream = streams.stream_files(spark, f"{folder}/*", AUDIT_SCHEMA, maxFilesPerTrigger=1, latestFirst=False)
    got, query = windows(spark, streams.stream_row_quota(stream, bundle), tmp_path, "quota")
    shown = sorted((r["agent_id"], r["window_start"], r["rows"], r["max_rows"]) for r in got.collect())
    assert shown == [("a", START, 120, 100), ("a", START + timedelta(hours=3), 180, 100)]
    assert streams.late_rows(query) == 1


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [
        {"seq": i, "agent_id": f"a{i % 2}", "timestamp": START + timedelta(seconds=i), "row_count": 1}
        for i in range(4000)
    ]
    for part in range(4):
        land(spark, rows[part * 1000 : part * 1000 + 1000], folder, part)
    stream = streams.stream_files(spark, f"{folder}/*", AUDIT_SCHEMA, maxFilesPerTrigger=1)
    got = {tuple(r) for r in windows(spark, streams.stream_rate_limit(stream, 20), tmp_path, "rate")[0].collect()}
    batch = spark.read.schema(AUDIT_SCHEMA).parquet(f"{folder}/*")
    want = {tuple(r) for r in trail.rate_limit_breaches(batch, 20).collect()}
    assert want and got == want


def test_streams_share_a_target_and_it_is_folded(spark, tmp_path):
    """Two streams, a new checkpoint, and a fold between: the last state of each window stands, in few rows."""
    path = str(tmp_path / "shared")
    for name, agent in (("x", "a"), ("y", "b")):
        rows = [{"seq": i, "agent_id": agent, "timestamp": START + timedelta(minutes=i), "row_count": 1} for i in range(90)]
        for part in range(3):
            land(spark, rows[part * 30 : part * 30 + 30], str(tmp_path / name), part)

    def run(name, state, files):
        stream = streams.stream_files(spark, f"{tmp_path / name}/*", AUDIT_SCHEMA, maxFilesPerTrigger=files)
        df = streams.stream_rate_limit(stream, 0, "1 hour")
        streams.drain(streams.run_to_windows(df, path, str(tmp_path / state), availableNow=True))
        return streams.read_windows(spark, path, df.schema)

    run("x", "x-state", 1)
    got = run("y", "y-state", 1)
    want = sorted((agent, START + timedelta(hours=h), n) for agent in "ab" for h, n in ((0, 60), (1, 30)))
    assert sorted(map(tuple, got.collect())) == want
    streams.fold_windows(spark, path)
    stored = SnapshotTable(spark, path)
    assert stored.read().count() == 4
    assert sorted(map(tuple, run("x", "fresh-state", 3).collect())) == want  # from a new checkpoint, over the same log
    versions = stored.version()
    assert sorted(map(tuple, run("x", "x-state", 1).collect())) == want and stored.version() == versions  # nothing is left to read


def test_peak_concurrency_as_it_arrives_equals_the_batch_answer(spark, bundle, tmp_path):
    """Files out of order within the lateness, entries of one instant, a restart, and one entry that is too late."""
    rng = random.Random(8)
    rows = [
        {"seq": k, "agent_id": rng.choice(["steward", "planner", "nobody"]), "timestamp": START + timedelta(seconds=k // 2 + rng.randint(0, 200)),
         "duration_ms": rng.choice([None, 0, 500, 1000, 90_000, 400_000])}
        for k in range(1500)
    ]
    folder = str(tmp_path / "log")
    batch = local_frame(spark, [{"source": "s", "action": "QUERY", "resource": "t", "policy_decision": "permitted", **r} for r in rows], AUDIT_SCHEMA)
    want = sorted(map(tuple, trail.peak_concurrency(batch, bundle).collect()))

    def run():
        stream = streams.stream_files(spark, f"{folder}/*", AUDIT_SCHEMA, maxFilesPerTrigger=1)
        df = streams.stream_peak_concurrency(stream, bundle)
        streams.drain(streams.run_to_windows(df, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True))
        return sorted(map(tuple, streams.read_windows(spark, str(tmp_path / "out"), df.schema, ["agent_id"]).collect()))

    for part in range(3):
        land(spark, rows[part * 250 : part * 250 + 250], folder, part)
    first = run()
    assert all(r[1] <= w[1] for r, w in zip(first, want, strict=True))
    for part in range(3, 6):
        land(spark, rows[part * 250 : part * 250 + 250], folder, part)
    assert run() == want
    far = [{"seq": 9000, "agent_id": "planner", "timestamp": START + timedelta(days=1), "duration_ms": 10}]
    late = [{"seq": 9001 + k, "agent_id": "planner", "timestamp": START + timedelta(seconds=700), "duration_ms": 400_000} for k in range(300)]
    land(spark, far, folder, 6)
    land(spark, far, folder, 7)
    run()
    land(spark, late, folder, 8)
    assert run() == want


REQUESTS = "request_id bigint, ts timestamp_ntz, agent string, source string, query string"


def requests(spark, n, offset=0):
    agents, texts = ["steward", "map-reader", "x"], ["SELECT * FROM nation", "DELETE FROM orders", ""]
    rows = [(offset + i, START, agents[i % 3], "warehouse", texts[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, REQUESTS)


def test_decisions_append_exactly_once_across_restarts(spark, bundle, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "audit", "state"))
    wanted = []
    for round_ in range(2):
        batch = requests(spark, 30, offset=round_ * 100)
        batch.write.mode("append").parquet(folder)
        wanted += request_outcome(batch, bundle).select("request_id", "stage").collect()
        stream = streams.stream_files(spark, folder, batch.schema)
        query = append_audit_stream(
            streams.stream_audit_entries(stream, bundle), path, state, availableNow=True
        )
        streams.drain(query)
    got = read_audit(spark, path).select("seq", "policy_decision").collect()
    assert sorted(map(tuple, got)) == sorted(
        (r["request_id"], "permitted" if r["stage"] == "permitted" else "denied") for r in wanted
    )
    assert stream_audit(spark, path).isStreaming


def test_decisions_with_stored_policies(spark, bundle, tmp_path):
    folder = str(tmp_path / "in")
    requests(spark, 12).write.parquet(folder)
    stream = streams.stream_files(spark, folder, requests(spark, 1).schema)
    ended = streams.stream_decisions(stream, bundle.with_tables()).select("request_id", "stage", "reason")
    got = drained(spark, ended, tmp_path, "out").collect()
    want = request_outcome(requests(spark, 12), bundle).select("request_id", "stage", "reason").collect()
    assert sorted(got) == sorted(want)


def test_governed_stream(spark, tables, bundle, sf, tmp_path):
    access = check_access(bundle, "steward", "warehouse", ["customer"])["customer"]
    schema = spark.read.parquet(f"{sf}/customer.parquet").schema
    stream = streams.stream_files(spark, f"{sf}/customer*.parquet", schema)
    got = drained(spark, streams.stream_governed(stream, access), tmp_path, "out")
    batch = governed_table(spark, tables, bundle, "steward", "warehouse", "customer").df
    assert sorted(got.collect()) == sorted(batch.collect())


def test_peak_state_is_touched_by_the_hour_not_by_the_step(monkeypatch):
    """Thousands of entries cost a handful of state calls, over two batches and a watermark between; levels as by brute force."""
    rng = random.Random(3)

    class Value:
        def __init__(self):
            self.held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        calls = 0

        def getValue(self, key):  # noqa: N802
            Map.calls += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            Map.calls += 1
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            Map.calls += 1
            del self[key]

        def containsKey(self, key):  # noqa: N802
            Map.calls += 1
            return key in self

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

        def getMapState(self, *_):  # noqa: N802
            return Map()

        def listTimers(self):  # noqa: N802
            return []

        def registerTimer(self, at):  # noqa: N802
            self.timer = at

    class Times:
        mark = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.mark

    monkeypatch.setattr(streams, "_ENTRIES", 1500)
    levels, times = streams._Levels(), Times()
    levels.init(Handle())
    seen = []
    for batch in range(2):
        lo = batch * 3 * 3_600_000_000
        spans = [(lo + rng.randrange(3 * 3600) * 1_000_000, rng.choice([1, 30, 5000]) * 1_000_000) for _ in range(4000)]
        seen += [(a, a + d) for a, d in spans]
        frames = [pd.DataFrame({"start": [a for a, _ in part], "end": [a + d for a, d in part]}) for part in (spans[:1000], spans[1000:2500], spans[2500:])]
        (out,) = levels.handleInputRows(("a",), iter(frames), times)
        steps = sorted([(t, 1) for t, _ in seen] + [(t, -1) for _, t in seen], key=lambda x: x)  # ends before starts
        now = peak = 0
        for _, step in steps:
            now += step
            peak = max(peak, now)
        assert out["peak"].tolist() == [peak]
        times.mark = (lo + 3 * 3_600_000_000) // 1000
    assert Map.calls < 120
    times.mark = 10**9
    assert all(frame.empty for frame in levels.handleExpiredTimer(("a",), times, None))
    assert levels.hours == {} and levels.level.get()[:2] == (0, peak)
