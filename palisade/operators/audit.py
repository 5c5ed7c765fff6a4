"""Audit records and what can be read off them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from threading import Lock, Thread
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation, functions as F

from palisade.operators.enforce import GovernedTable
from palisade.operators.lookups import with_agent_policy
from palisade.operators.prefix import as_of, peak_level, running_sum
from palisade.sources.audit_log import AUDIT_SCHEMA, append_audit, audit_columns
from palisade.sources.policy import Bundle, local_frame

DENIED_STAGES = ("scope_denied", "governance_denied", "approval_required")


_lock = Lock()
_used = [0]  # the last seq given out


def _stamp(agent: str, source: str, resource: str, action: str, decision: str) -> dict:
    """An entry of now. ``seq`` counts microseconds since 1970 (UTC, whatever the driver's zone);
    entries of one driver within a microsecond get following numbers."""
    now = datetime.now(timezone.utc)
    since = now - datetime(1970, 1, 1, tzinfo=timezone.utc)
    with _lock:
        _used[0] = max(_used[0] + 1, (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds)
        seq = _used[0]
    return {
        "seq": seq,
        "timestamp": now.replace(tzinfo=None),
        "agent_id": agent,
        "source": source,
        "action": action,
        "resource": resource,
        "policy_decision": decision,
    }


def run_recorded(
    df: DataFrame,
    action: Callable[[DataFrame], object],
    path: str,
    agent: str,
    source: str,
    resource: str,
    name: str = "QUERY",
) -> dict:
    """Run ``action`` on the frame and append its audit record, whatever happens: ``permitted``,
    or ``failed`` if the action raised. Rows are counted by an observation inside the same job,
    not by a second one; an action that never runs the frame leaves no row count."""
    seen, clock = Observation(), perf_counter()
    entry = _stamp(agent, source, resource, name, "permitted")
    try:
        action(df.observe(seen, F.count(F.lit(1)).alias("row_count")))
        entry["row_count"] = _observed(seen)
    except BaseException:
        entry["policy_decision"] = "failed"
        raise
    finally:
        entry["duration_ms"] = round((perf_counter() - clock) * 1000)
        append_audit(local_frame(df.sparkSession, [entry], AUDIT_SCHEMA), path)
    return entry


def _observed(seen: Observation, wait: float = 5.0) -> int | None:
    """The count, once the finished job has reported it; None if no job did within ``wait`` seconds."""
    found: list[int] = []
    reader = Thread(target=lambda: found.append(seen.get["row_count"]), daemon=True)
    reader.start()
    reader.join(wait)
    return found[0] if found else None


def run_audited(
    table: GovernedTable, action: Callable[[DataFrame], object], path: str, name: str = "QUERY"
) -> dict:
    """``run_recorded`` on a governed table under its row cap."""
    access = table.access
    return run_recorded(table.capped(), action, path, access.agent, access.source, access.table, name)


def log_denial(spark, agent: str, source: str, resource: str, path: str, name: str = "QUERY") -> dict:
    entry = _stamp(agent, source, resource, name, "denied")
    append_audit(local_frame(spark, [entry], AUDIT_SCHEMA), path)
    return entry


def audit_of_outcomes(outcomes: DataFrame, action: str = "BATCH_QUERY") -> DataFrame:
    """One entry per outcome, every stage included; ``ts`` and ``request_id`` of the requests
    become timestamp and seq."""
    permitted = F.col("stage") == "permitted"
    return audit_columns(
        outcomes.select(
            F.col("request_id").alias("seq"),
            F.col("ts").alias("timestamp"),
            F.col("agent").alias("agent_id"),
            "source",
            F.lit(action).alias("action"),
            F.col("table").alias("resource"),
            F.when(permitted, F.lit("permitted")).otherwise(F.lit("denied")).alias("policy_decision"),
        )
    )


def audit_of_scope_outcomes(outcomes: DataFrame, action: str = "QUERY") -> DataFrame:
    """Entries of the scope-only variant: requests without source or agent leave none, an
    unknown source is logged with resource ``unknown``, permitted ones with 0 rows."""
    code = F.col("status_code")
    return audit_columns(
        outcomes.filter(code != 400).select(
            F.col("request_id").alias("seq"),
            F.col("ts").alias("timestamp"),
            F.col("agent").alias("agent_id"),
            "source",
            F.lit(action).alias("action"),
            F.when(code == 404, F.lit("unknown")).otherwise(F.col("table")).alias("resource"),
            F.when(code == 200, F.lit(0)).alias("row_count"),
            F.when(code == 200, F.lit("permitted")).otherwise(F.lit("denied")).alias("policy_decision"),
        )
    )


def view_audit(audit: DataFrame, agent: str | None = None, limit: int = 20) -> DataFrame:
    """Newest entries first, whoever wrote them; ``seq`` only orders entries of one instant. A top-k, so only
    the k rows of each task move."""
    own = audit if agent is None else audit.filter(F.col("agent_id") == agent)
    return own.orderBy(F.col("timestamp").desc_nulls_last(), F.col("seq").desc()).limit(max(1, limit))


def audit_total(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("total"))


def health_counts(bundle: Bundle, audit: DataFrame | None = None) -> DataFrame:
    """source_count, scope_count (and entry_count of the audit trail) in one row."""
    scopes = bundle.scope_rules.groupBy("agent", "scope_pos").agg(F.lit(1).alias("one"))
    out = bundle.sources.agg(F.count("*").alias("source_count"))
    out = out.withColumn("scope_count", scopes.agg(F.count("*")).scalar())
    if audit is not None:
        out = out.withColumn("entry_count", audit.agg(F.count("*")).scalar())
    return out


def _usage() -> list[Column]:
    denied = F.col("policy_decision") == "denied"
    return [
        F.count("*").alias("requests"),
        F.count_if(denied).alias("denials"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
    ]


def access_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("agent_id", "source", "resource").agg(*_usage())


def access_rollup(audit: DataFrame) -> DataFrame:
    """Totals per agent, per agent and source, and per resource. The trail is folded to one
    row per group first, so the rollup expands groups and not log entries."""
    return _regroup(access_summary(audit).rollup("agent_id", "source", "resource"))


def access_cube(audit: DataFrame) -> DataFrame:
    return _regroup(access_summary(audit).cube("agent_id", "source", "resource"))


def _regroup(grouped) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("requests", "denials", "rows", "total_ms")]
    return grouped.agg(F.grouping_id().alias("level"), *sums, F.max("max_ms").alias("max_ms"))


def retained(audit: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Entries of the last ``days`` days and those without a time; the test reaches the scan."""
    at = F.col("timestamp")
    return audit.filter(at.isNull() | (at >= as_of - F.make_dt_interval(F.lit(days))))


def expired(audit: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The complement: what retention moves to the archive (entries without a time stay)."""
    return audit.filter(F.col("timestamp") < as_of - F.make_dt_interval(F.lit(days)))


def retention_split(audit: DataFrame, bundle: Bundle, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) by the days the policies set; every entry is in exactly one of them."""
    return retained(audit, as_of, bundle.audit_log_days), expired(audit, as_of, bundle.audit_log_days)


def _with_policy(audit: DataFrame, bundle: Bundle) -> DataFrame:
    return with_agent_policy(audit.withColumnRenamed("agent_id", "agent"), bundle, "policy")


def timeout_breaches(audit: DataFrame, bundle: Bundle) -> DataFrame:
    found = _with_policy(audit, bundle).filter(F.col("duration_ms") > F.col("policy.timeout_ms"))
    return found.select(
        "seq", F.col("agent").alias("agent_id"), "duration_ms", F.col("policy.timeout_ms").alias("timeout_ms")
    )


def peak_concurrency(audit: DataFrame, bundle: Bundle) -> DataFrame:
    """(agent_id, peak, max_concurrency, breached) from overlapping [start, start + duration).

    Starts and ends at one instant fold into one net step first: an end frees its slot
    before a start takes one, so the level after the instant is the highest around it.
    """
    timed = audit.filter("duration_ms is not null and duration_ms > 0 and timestamp is not null")
    end = F.expr("timestamp + duration_ms * INTERVAL '0.001' SECOND")
    steps = timed.select(
        "agent_id",
        F.explode(
            F.array(
                F.struct(F.col("timestamp").alias("t"), F.lit(1).alias("step")),
                F.struct(end.alias("t"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    )
    net = steps.groupBy("agent_id", F.col("e.t").alias("t")).agg(F.sum("e.step").alias("net"))
    return peaks_judged(peak_level(net, "agent_id", "t", "net"), bundle)


def peaks_judged(peaks: DataFrame, bundle: Bundle) -> DataFrame:
    """Peaks (agent_id, peak) beside what the agent's policy allows; batch and stream."""
    return _with_policy(peaks, bundle).select(
        F.col("agent").alias("agent_id"),
        "peak",
        F.col("policy.max_concurrency").alias("max_concurrency"),
        (F.col("peak") > F.col("policy.max_concurrency")).alias("breached"),
    )


def rate_windows(audit: DataFrame, length: str = "1 minute") -> DataFrame:
    """Requests per agent and tumbling window; batch and stream."""
    counted = audit.groupBy(F.window("timestamp", length).alias("w"), "agent_id").agg(F.count("*").alias("requests"))
    return counted.select("agent_id", F.col("w.start").alias("window_start"), "requests")


def rate_limit_breaches(audit: DataFrame, most: int = 100, length: str = "1 minute") -> DataFrame:
    return rate_windows(audit, length).filter(F.col("requests") > most)


def sliding_rates(audit: DataFrame, length: str = "60 seconds", **spread) -> DataFrame:
    """Each entry with ``in_window``: the entries of its agent in the time of ``length`` that ends with it, itself included.

    Entries of one instant count in ``seq`` order, and one exactly ``length`` ago no longer counts. An entry's rank among
    its agent's, less the rank that was reached ``length`` before: a running sum and an as-of lookup, both over equal
    ranges, so an agent or an instant with most of the entries is split.
    """
    rows = audit.filter("timestamp is not null and agent_id is not null").select("seq", "agent_id", "timestamp").withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(rows, ["agent_id"], "timestamp", ["seq"], "_one", "_rank", **spread)
    ranked = ranked.withColumn("_before", F.col("timestamp") - F.expr(f"INTERVAL '{length}'"))
    reached = ranked.groupBy("agent_id", "timestamp").agg(F.struct(F.max("_rank").alias("rank")).alias("_reached"))
    met = as_of(ranked, reached, ["agent_id"], "_before", "timestamp", "_reached", "_found", **spread)
    count = F.col("_rank") - F.coalesce("_found.rank", F.lit(0))
    return met.select("seq", "agent_id", "timestamp", count.alias("in_window"))


def sliding_limit_breaches(audit: DataFrame, most: int = 100, length: str = "60 seconds", **spread) -> DataFrame:
    """Entries with which an agent went over ``most`` requests in any time of ``length``, wherever minutes begin."""
    return sliding_rates(audit, length, **spread).filter(F.col("in_window") > most)


def usage_sketches(audit: DataFrame, length: str = "1 hour") -> DataFrame:
    """Per agent and window: entries, and mergeable sketches of the resources asked for and of the durations. Kept as a table,
    ``usage_of_sketches`` answers from it for any agents and spans without the log."""
    timed = audit.filter("timestamp is not null").withColumn("window_start", F.window("timestamp", length)["start"])
    return timed.groupBy("agent_id", "window_start").agg(
        F.count("*").alias("requests"),
        F.hll_sketch_agg("resource").alias("resources"),
        F.kll_sketch_agg_bigint("duration_ms").alias("durations"),
    )


def usage_of_sketches(sketches: DataFrame, *keys: str, ranks: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """Of the sketches of each group: requests, the number of distinct resources, and quantiles of the durations (NULL where
    there are none). Estimates, exact for small groups: about 2 % for the numbers, 1.5 % of rank for the quantiles."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("requests").alias("requests"),
        F.hll_sketch_estimate(F.hll_union_agg("resources")).alias("resources"),
        F.kll_merge_agg_bigint("durations").alias("_durations"),
    )
    any_ = F.kll_sketch_get_n_bigint("_durations") > 0
    at = [F.when(any_, F.kll_sketch_get_quantile_bigint("_durations", F.lit(float(r)))).alias(f"ms_p{100 * r:g}".replace(".", "_")) for r in ranks]
    return merged.select(*keys, "requests", "resources", *at)


def row_quota(audit: DataFrame, bundle: Bundle, length: str = "1 hour", **spread) -> DataFrame:
    """Entries after which an agent had received more rows in the window than its cap."""
    rows = audit.filter("row_count is not null and timestamp is not null").select(
        "seq", F.col("agent_id"), "timestamp", F.window("timestamp", length)["start"].alias("window_start"), "row_count"
    )
    used = running_sum(rows, ["agent_id", "window_start"], "timestamp", ["seq"], "row_count", "rows_so_far", **spread)
    cap = F.col("policy.max_rows")
    return (
        _with_policy(used, bundle)
        .filter((cap > 0) & (F.col("rows_so_far") > cap))
        .select(
            "seq", F.col("agent").alias("agent_id"), "window_start", "row_count", "rows_so_far", cap.alias("max_rows")
        )
    )


def quota_windows(audit: DataFrame, length: str = "1 hour") -> DataFrame:
    """Rows per agent and tumbling window; batch and stream."""
    used = audit.groupBy(F.window("timestamp", length).alias("w"), "agent_id").agg(F.sum("row_count").alias("rows"))
    return used.select("agent_id", F.col("w.start").alias("window_start"), "rows")


def quota_breaches(windows: DataFrame, bundle: Bundle) -> DataFrame:
    """Windows in which an agent received more rows than its cap; batch and stream."""
    cap = F.col("policy.max_rows")
    over = _with_policy(windows, bundle).filter((cap > 0) & (F.col("rows") > cap))
    return over.select(F.col("agent").alias("agent_id"), "window_start", "rows", cap.alias("max_rows"))
