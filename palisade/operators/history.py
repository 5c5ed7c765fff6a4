"""Policies as of the time of a request.

A history holds the decision lookups as they were: a row holds for its key from ``valid_from`` until ``valid_to``
or a later row of that key, whichever comes first; its ``state`` may be NULL, for none. Decisions take, for each
request, the state in force at its own time (UTC wall clock), so a log can be judged again across policy changes.

Small histories meet requests as one list of states for each key, in one narrow pass, on batches and streams alike. Others
do so by a shuffled join as long as no key has over ``LISTED`` rows. Where one has, every key's rows and requests are put in one order and cut into equal ranges: the last state goes along inside
a range, and from range to range, so no join compares times and a hot key, or a key with a long history, is split.

A request without a time, or from before the first version, is judged by the built-in default policy alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palisade.operators.decisions import AGENT_SIDE, DECISION, MASKS_ASKED, UNGOVERNED
from palisade.operators.lookups import AGENT_POLICY, agent_lookup, masked_tables, source_lookup, splittable
from palisade.operators.prefix import as_of
from palisade.sources.config import AGENT_DEFAULTS, DEFAULT_AGENT
from palisade.sources.policy import FLAG, MASKS, SCHEMAS, Bundle, agent_row, local_frame

KEYS = {"agents": ["agent"], "sources": ["source"], "tables": ["source", "table"]}
_TABLE = ("classification", "row_filter", "max_rows", "approve_writes", "masks")
_TIME = T.TimestampNTZType()
#: Rows of a key that a stored history joins to requests as one list.
LISTED = 16
_SETTINGS = T.StructType([T.StructField("valid_from", _TIME), T.StructField("enabled", FLAG), *SCHEMAS["agent_policy"].fields])


def _states(bundle: Bundle) -> dict[str, DataFrame]:
    """Each lookup as its keys and one ``state``."""
    sources = source_lookup(bundle).select("source", F.struct(F.col("default_class").alias("default_class")).alias("state"))
    return {
        "agents": agent_lookup(bundle).select("agent", F.col("agent_policy").alias("state")),
        "sources": sources,
        "tables": masked_tables(bundle).select("source", "table", F.struct(*_TABLE).alias("state")),
    }


def _dated(rows: DataFrame, start: datetime, end: datetime | None) -> DataFrame:
    return rows.withColumns({"valid_from": F.lit(start).cast(_TIME), "valid_to": F.lit(end).cast(_TIME)})


@dataclass(frozen=True)
class PolicyHistory:
    agents: DataFrame
    sources: DataFrame
    tables: DataFrame
    settings: DataFrame  # one row per version: valid_from, enabled and the default agent's policy
    small: bool = False

    @staticmethod
    def from_versions(spark: SparkSession, versions: Sequence[tuple[datetime, Bundle]]) -> PolicyHistory:
        """Whole policy sets, each in force from its instant until the next one's."""
        starts = [t for t, _ in versions]
        if not versions or sorted(set(starts)) != starts:
            raise ValueError("versions need rising times")
        parts: dict[str, list[DataFrame]] = {name: [] for name in KEYS}
        for (start, bundle), end in zip(versions, [*starts[1:], None], strict=True):
            for name, rows in _states(bundle).items():
                parts[name].append(_dated(rows, start, end))
        settings = [{**b.default_agent, "valid_from": t, "enabled": b.enabled} for t, b in versions]
        return PolicyHistory(
            **{name: reduce(DataFrame.unionByName, rows) for name, rows in parts.items()},
            settings=local_frame(spark, settings, _SETTINGS),
            small=all(b.small for _, b in versions),
        )

    def extended(self, start: datetime, bundle: Bundle) -> PolicyHistory:
        """With a further version: only keys whose state it changes get a row."""
        latest = self.settings.agg(F.max("valid_from")).first()[0]
        if latest is not None and latest >= start:
            raise ValueError("versions need rising times")
        new = _states(bundle)
        now = F.lit(start).cast(_TIME)
        grown = {}
        for name, keys in KEYS.items():
            rows: DataFrame = getattr(self, name)
            last = rows.groupBy(*keys).agg(F.max_by(F.struct("state", "valid_to"), "valid_from").alias("last"))
            held = F.when(F.col("last.valid_to").isNull() | (F.col("last.valid_to") > now), F.col("last.state"))
            before = last.select(*keys, held.alias("old"))
            met = before.join(new[name], keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("state")))
            grown[name] = rows.unionByName(_dated(met.select(*keys, "state"), start, None))
        setting = local_frame(rows.sparkSession, [{**bundle.default_agent, "valid_from": start, "enabled": bundle.enabled}], _SETTINGS)
        return replace(self, **grown, settings=self.settings.unionByName(setting), small=self.small and bundle.small)

    def write(self, path: str) -> None:
        for name in (*KEYS, "settings"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PolicyHistory:
        return PolicyHistory(**{name: spark.read.parquet(f"{path}/{name}") for name in (*KEYS, "settings")})


def _in_force(versions: Column, at: Column) -> Column:
    """The last of a sorted list of versions (valid_from, valid_to, state) that has begun, unless it has ended."""
    begun = F.try_element_at(F.filter(versions, lambda v: v["valid_from"] <= at), F.lit(-1))
    return F.when(begun["valid_to"].isNull() | (begun["valid_to"] > at), begun["state"])


def _listed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "state"))).alias("_versions"))


def _longest(rows: DataFrame, keys: Sequence[str]) -> int:
    """The most rows that a key has."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def with_state(requests: DataFrame, rows: DataFrame, keys: Sequence[str], small: bool, name: str, at: str = "_at") -> DataFrame:
    """Add the state of the request's key at its time."""
    if small or requests.isStreaming or _longest(rows, keys) <= LISTED:
        lists = rows.select(*keys, "valid_from", "valid_to", F.struct("state").alias("state"))
        lists = _listed(lists, keys)
        lists = F.broadcast(lists) if small else splittable(lists, keys[0])
        joined = requests.join(lists, list(keys), "left")
        return joined.select(*requests.columns, _in_force(F.col("_versions"), F.col(at))["state"].alias(name))
    known = rows.select(*keys, "valid_from", F.struct("state", "valid_to").alias("value"))
    found = as_of(requests, known, keys, at, "valid_from", "value", "_value")
    ended = F.col("_value.valid_to") <= F.col(at)
    return found.select(*requests.columns, F.when(~F.coalesce(ended, F.lit(False)), F.col("_value.state")).alias(name))


def _settings(history: PolicyHistory) -> Column:
    """enabled and the default agent's policy of each version: a list that came from the driver."""
    state = F.struct("enabled", F.expr(AGENT_POLICY).alias("policy"))
    no_end = F.lit(None).cast(_TIME).alias("valid_to")
    rows = history.settings.select("valid_from", no_end, state.alias("state"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "state")))).scalar()


def _built_in(history: PolicyHistory) -> Column:
    row = agent_row(-1, {**AGENT_DEFAULTS, **DEFAULT_AGENT})
    return local_frame(history.settings.sparkSession, [row], SCHEMAS["agent_policy"]).select(F.expr(AGENT_POLICY).alias("p")).scalar()


def decide_as_of(requests: DataFrame, history: PolicyHistory, at: str = "ts", name: str = "decision") -> DataFrame:
    """``decisions.decide`` by the policies in force at ``at`` of each request; batch and stream."""
    own = requests.columns
    timed = requests.withColumn("_at", F.col(at).cast(_TIME))
    found = with_state(timed, history.agents, ["agent"], history.small, "_state")
    found = found.withColumn("_settings", _settings(history))
    found = found.withColumn("_setting", _in_force(F.col("_settings"), F.col("_at")))
    policy = F.coalesce("_state", "_setting.policy", _built_in(history))
    found = found.withColumn("_policy", policy).selectExpr(
        *[f"`{c}`" for c in own], "_at", "coalesce(_setting.enabled, true) AS _enabled", *AGENT_SIDE
    )
    found = with_state(found, history.sources, ["source"], history.small, "_source")
    found = with_state(found, history.tables, ["source", "table"], history.small, "_table")
    label = F.coalesce(F.nullif("_table.classification", F.lit("")), F.nullif("_source.default_class", F.lit("")), F.lit("internal"))
    found = found.withColumns(
        {
            "_class": label,
            "_row_filter": F.col("_table.row_filter"),
            "_table_cap": F.col("_table.max_rows"),
            "_table_approve": F.col("_table.approve_writes"),
            "_table_masks": F.col("_table.masks"),
        }
    )
    masks = F.expr(MASKS_ASKED) if "columns" in own else F.lit(None).cast(MASKS)
    found = found.withColumn("_masks", masks)
    return found.select(*own, F.when(F.col("_enabled"), F.expr(DECISION)).otherwise(F.expr(UNGOVERNED)).alias(name))
