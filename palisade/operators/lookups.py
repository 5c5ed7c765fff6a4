"""First-match policy lookups: one row per key, ready for a left join.

Each lookup has two forms with one result: a small bundle is resolved on the driver and
becomes a literal relation, any other bundle is resolved by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.classes import clearance
from palisade.operators.single import chosen_columns, chosen_tables, first_rows
from palisade.session import materialise
from palisade.sources.policy import FLAG, LONG, MASKS, SCHEMAS, TEXT, Bundle, local_frame, struct


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key in every map task before the
    shuffle (WindowGroupLimit), so a key with very many rows stays cheap."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_match", rank).filter("_match = 1").drop("_match")


def splittable(lookup: DataFrame, key: str) -> DataFrame:
    """Let adaptive execution split a hot key of whatever this lookup is joined to.

    It only does so where both sides come straight from a shuffle. A lookup grouped by its
    join key would be joined where it lies; with its text key rewritten, Spark shuffles the
    (short) lookup once more and can split the long side.
    """
    return lookup.withColumn(key, F.concat(F.col(key), F.lit("")))


def folded(requests: DataFrame, keys: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``judge`` (which adds columns) asked once for each distinct combination of ``keys``.

    A log of requests then moves twice at most, however many lookups there are: folded before
    the first shuffle, and to meet the answers.
    """
    asked = requests.select(*keys).distinct()
    answers = judge(asked)
    new = [c for c in answers.columns if c not in keys]
    a, b = requests.alias("a"), answers.alias("b")
    same = reduce(and_, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    return a.join(b, same, "left").select("a.*", *[F.col(f"b.`{c}`") for c in new])


AGENT_POLICY = f"""named_struct(
    'rank', {clearance('allowed_classes')},
    'allowed_ops', allowed_ops,
    'allowed_sources', allowed_sources,
    'max_rows', max_rows,
    'approve_writes', coalesce(approve_writes, false),
    'max_concurrency', max_concurrency,
    'timeout_ms', timeout_ms)"""


def agent_lookup(bundle: Bundle) -> DataFrame:
    """(agent, agent_policy struct)"""
    if "agents" in bundle.resolved:
        return bundle.resolved["agents"]
    if bundle.small:
        rows = first_rows(bundle.rows["agent_policy"], ["agent"], ["pos"])
        found = local_frame(bundle.spark, rows, SCHEMAS["agent_policy"])
    else:
        found = splittable(first_match(bundle.agent_policy, ["agent"], ["pos"]), "agent")
    return found.select("agent", F.expr(AGENT_POLICY).alias("agent_policy"))


def default_agent(bundle: Bundle) -> Column:
    """The policy of agents without one: a one-row relation as a scalar."""
    row = local_frame(bundle.spark, [bundle.default_agent], SCHEMAS["agent_policy"])
    return row.select(F.expr(AGENT_POLICY).alias("agent_policy")).scalar()


def with_agent_policy(requests: DataFrame, bundle: Bundle, name: str = "agent_policy") -> DataFrame:
    """Add the explicit policy of the agent, else the default one."""
    found = agent_lookup(bundle).withColumnRenamed("agent_policy", "_found")
    joined = requests.join(bundle.hint(found), "agent", "left")
    return joined.select(*requests.columns, F.coalesce("_found", default_agent(bundle)).alias(name))


def source_lookup(bundle: Bundle) -> DataFrame:
    """(source_pos, source, default_class)"""
    if "sources" in bundle.resolved:
        return bundle.resolved["sources"]
    if bundle.small:
        rows = first_rows(bundle.rows["source_policy"], ["source"], ["source_pos"])
        return local_frame(bundle.spark, rows, SCHEMAS["source_policy"])
    return splittable(first_match(bundle.source_policy, ["source"], ["source_pos"]), "source")


def table_lookup(bundle: Bundle) -> DataFrame:
    """Table policies of the first policy entry of their source, first one per table."""
    if "tables" in bundle.resolved:
        return bundle.resolved["tables"]
    if bundle.small:
        return local_frame(bundle.spark, chosen_tables(bundle.rows), SCHEMAS["table_policy"])
    chosen = source_lookup(bundle).select("source", "source_pos")
    own = bundle.table_policy.join(chosen, ["source", "source_pos"], "left_semi")
    return splittable(first_match(own, ["source", "table"], ["table_pos"]), "source")


def column_lookup(bundle: Bundle) -> DataFrame:
    """Column policies that belong to the chosen table policies, in list order (``pos``)."""
    if "columns" in bundle.resolved:
        return bundle.resolved["columns"]
    if bundle.small:
        return local_frame(bundle.spark, chosen_columns(bundle.rows), SCHEMAS["column_policy"])
    at = ["source", "source_pos", "table", "table_pos"]
    return bundle.column_policy.join(table_lookup(bundle).select(*at), at, "left_semi")


def first_column_lookup(bundle: Bundle) -> DataFrame:
    """One policy per (source, table, column)."""
    return first_match(column_lookup(bundle), ["source", "table", "name"], ["pos"])


MASKED_TABLE = struct(
    source=TEXT, table=TEXT, classification=TEXT, row_filter=TEXT, max_rows=LONG, approve_writes=FLAG, masks=MASKS
)


def masked_tables(bundle: Bundle) -> DataFrame:
    """Table policies together with their masked columns in policy order: a list as long as
    the table's own column policy, whatever the number of tables."""
    if "masked" in bundle.resolved:
        return bundle.resolved["masked"]
    if not bundle.small:
        return _with_lists(table_lookup(bundle), column_lookup(bundle))
    masks: dict[tuple, list] = {}
    for c in chosen_columns(bundle.rows):
        if c["masking"] != "none":
            mask = {"name": c["name"], "strategy": c["masking"], "format": c.get("mask_format")}
            masks.setdefault((c["source"], c["table"]), []).append(mask)
    rows = [{**t, "masks": masks.get((t["source"], t["table"]))} for t in chosen_tables(bundle.rows)]
    return local_frame(bundle.spark, rows, MASKED_TABLE)


def _with_lists(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Add each table's masked columns as one list."""
    masked = columns.filter("masking <> 'none'")
    item = F.struct("pos", "name", F.col("masking").alias("strategy"), F.col("mask_format").alias("format"))
    lists = masked.groupBy("source", "table").agg(F.sort_array(F.collect_list(item)).alias("masks"))
    plain = F.expr("transform(masks, m -> struct(m.name AS name, m.strategy AS strategy, m.format AS format))")
    joined = tables.join(lists.withColumn("masks", plain), ["source", "table"], "left")
    return splittable(joined.select(*tables.columns, "masks"), "source")


def resolve(bundle: Bundle) -> Bundle:
    """Work out the policy lookups of a large bundle once and keep them as tables in the
    shared folder. Decisions then scan small resolved tables whose size Catalyst knows,
    however often they are asked. Redo it when policies change."""
    if bundle.small:
        return bundle
    kept: dict[str, DataFrame] = {}
    bundle = replace(bundle, resolved=kept)
    for name, lookup in (
        ("agents", agent_lookup),
        ("sources", source_lookup),
        ("tables", table_lookup),
        ("columns", column_lookup),
        ("masked", masked_tables),
    ):
        kept[name] = materialise(lookup(bundle), name)
    return bundle
