"""What becomes of a request, from its raw text to the final verdict."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.querytext import WRITES, query_columns, query_operation, query_table
from palisade.operators.decisions import decide
from palisade.operators.lookups import splittable
from palisade.operators.scope import scope_decision
from palisade.sources.policy import TEXT, Bundle, local_frame, struct

# The stages a request can end in, in the order they are tested.
STAGES = (
    "missing_params",
    "unknown_source",
    "scope_denied",
    "governance_denied",
    "approval_required",
    "no_source_reader",
    "permitted",
)


def known_sources(bundle: Bundle) -> DataFrame:
    if bundle.small:
        rows = [{"source": n} for n in dict.fromkeys(r["name"] for r in bundle.rows["sources"])]
        names = local_frame(bundle.spark, rows, struct(source=TEXT))
    else:
        names = splittable(bundle.sources.select(F.col("name").alias("source")).distinct(), "source")
    return bundle.hint(names.withColumn("_known", F.lit(True)))


def available_sources(bundle: Bundle) -> Column:
    """The names of all sources in list order, for messages: worked out once, as a scalar."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "name")))
    return bundle.sources.agg(F.array_join(F.transform(listed, lambda s: s["name"]), ", ").alias("names")).scalar()


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def request_outcome(
    requests: DataFrame,
    bundle: Bundle,
    *,
    readers: Iterable[str] | None = None,
    approvals: DataFrame | None = None,
    available: str | None = None,
) -> DataFrame:
    """Requests (request_id, agent, source, query) with table, operation, columns, the scope
    and governance decisions, and the stage and reason each one ends in.

    ``readers`` names the sources that can be read (default: all known ones); ``approvals``
    (request_id) lists writes somebody approved.
    """
    q = F.col("query")
    parsed = requests.withColumns(
        {"table": query_table(q), "operation": query_operation(q), "columns": query_columns(q)}
    )
    scoped = scope_decision(parsed.join(known_sources(bundle), "source", "left"), bundle)
    judged = decide(scoped, bundle)
    if approvals is None:
        judged = judged.withColumn("_approved", F.lit(False))
    else:
        granted = approvals.select("request_id").distinct().withColumn("_granted", F.lit(True))
        judged = judged.join(granted, "request_id", "left").withColumn("_approved", F.col("_granted").isNotNull())

    agent, source, table, operation = (F.col(c) for c in ("agent", "source", "table", "operation"))
    missing = _blank(agent) | _blank(q)
    unknown = F.col("_known").isNull()
    out_of_scope = ~F.col("scope.permitted")
    denied = ~F.col("decision.allowed")
    blocked = F.col("decision.requires_approval") & operation.isin(*WRITES) & ~F.col("_approved")
    readable = F.lit(True) if readers is None else F.coalesce(source.isin(*readers), F.lit(False))
    tests = [missing, unknown, out_of_scope, denied, blocked, ~readable]

    names = F.lit(available) if available is not None else available_sources(bundle)
    source_text = F.coalesce(source, F.lit("null"))
    # The texts of the reasons.
    texts = [
        F.lit("Missing required parameters: query and agent"),
        F.concat(F.lit("Unknown source: "), source_text, F.lit(". Available: "), names),
        F.concat(F.lit("Access denied: "), F.col("scope.reason")),
        F.concat(F.lit("Governance denied: "), F.col("decision.reason")),
        F.concat(
            F.lit("Write operation blocked: "), operation, F.lit(" on "), source_text, F.lit("."), table,
            F.lit(" requires approval."),
        ),
        F.concat(F.lit("No connector available for source: "), source_text),
    ]
    stage, reason = F.lit(STAGES[-1]), F.lit(None).cast("string")
    for test, name, text in reversed(list(zip(tests, STAGES, texts))):
        stage = F.when(test, F.lit(name)).otherwise(stage)
        reason = F.when(test, text).otherwise(reason)
    return judged.select(
        *parsed.columns, "scope", "decision", stage.alias("stage"), reason.alias("reason")
    )


def scope_only_outcome(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """The variant that checks presence, source and scope only; an empty query is allowed.
    Adds table, status_code, reason and the merged scope."""
    parsed = requests.withColumn("table", query_table(F.coalesce("query", F.lit(""))))
    judged = scope_decision(parsed.join(known_sources(bundle), "source", "left"), bundle)
    no_source, no_agent = _blank(F.col("source")), _blank(F.col("agent"))
    unknown, denied = F.col("_known").isNull(), ~F.col("scope.permitted")
    code = F.when(no_source | no_agent, 400).when(unknown, 404).when(denied, 403).otherwise(200)
    # The texts of the reasons.
    reason = (
        F.when(no_source, F.lit("Missing source name"))
        .when(no_agent, F.lit("Missing agent identifier"))
        .when(unknown, F.lit("Source not found"))
        .when(denied, F.concat(F.lit("Access denied: "), F.col("scope.reason")))
    )
    return judged.select(*parsed.columns, "scope", code.alias("status_code"), reason.alias("reason"))
