"""Mixing sources to target weights: budgets of tokens down a domain - language - source tree.

A node's capacity is the tokens of its documents times ``epochs``. The root gets ``share`` of all tokens, at
most its capacity. Each node deals its budget among its children by weight; a child that cannot take its
part takes its whole capacity, and its siblings share the rest by their weights. As capacities are those of
whole subtrees, a shortage is made up among siblings first, and only what a whole subtree lacks goes to
the siblings of its ancestors. Budgets are whole tokens and add up exactly.

A leaf's stream is its documents in a seeded order, then in the next epoch's order, and so on. The leaf
takes the longest prefix of that stream within its budget: some whole epochs, and the prefix of one more.
Running totals come from sums over equal slices of the order, and only the slice where the budget ends is
ordered row by row; so a leaf with a third of all rows is spread over ``4096`` slices.

NULL languages and sources are the name '' in the tree; NULL texts have no tokens. Documents without tokens
follow the prefix they stand in. Repeated rows are documents of their own; ties in the order go by tokens,
then by text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import materialise

from .exact import keep_rows

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order that name a slice.
SLICE_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measured(docs: DataFrame, domain: Column, tokens: Column) -> DataFrame:
    """doc_id, text_key, domain, lang, source and n_tokens of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"),
    )


def _weight(weights: Mapping[str, int], level: int) -> Column:
    """Weight of a node by its path ('domain', 'domain/lang', ...) or else by its own name; 1 if neither is given."""
    if not weights:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    path = F.concat_ws("/", *LEVELS[: level + 1])
    return F.coalesce(table[path], table[F.col(LEVELS[level])], F.lit(1)).cast("long")


def _dealt(nodes: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """``nodes`` (name columns, cap, budget of the parent as ``given``) with their own budget in ``budget``."""
    together = Window.partitionBy(*parents or [F.lit(0)])
    ordered = together.orderBy(F.col("cap") / F.col("w"), *LEVELS[: len(parents) + 1])
    earlier, upto = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    wide = "decimal(24,0)"
    weighed = nodes.withColumn("w", weight).withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
            "w_left": F.sum("w").over(together) - F.coalesce(F.sum("w").over(earlier), F.lit(0)),
        }
    )
    full = F.expr(f"cast(cap as {wide}) * cast(w_left as decimal(12,0)) <= cast(given - cap_before as {wide}) * cast(w as decimal(12,0))")
    split = weighed.withColumn("full", full).withColumns(
        {
            "rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(together), F.lit(0)),
            "w_rest": F.sum(F.when(~F.col("full"), F.col("w"))).over(together),
            "w_upto": F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(upto),
        }
    )
    part = f"cast(rest as {wide}) * cast(w_upto as decimal(12,0)) div w_rest - cast(rest as {wide}) * cast(w_upto - w as decimal(12,0)) div w_rest"
    return split.withColumn("budget", F.expr(f"case when full then cap else {part} end"))


def budgets(leaves: DataFrame, weights: Mapping[str, int], share: Fraction, epochs: int) -> DataFrame:
    """Budget of every leaf (domain, lang, source, tokens): whole epochs in ``whole`` and tokens beyond in ``rest``."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    goal = F.expr(f"cast(sum(tokens) over () as decimal(24,0)) * {share.numerator} div {share.denominator}")
    given = F.least(goal, F.expr("sum(cap) over ()"))
    dealt = caps.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).withColumn("given", given)
    for level in range(3):
        names = list(LEVELS[: level + 1])
        if level:
            above = dealt.select(*names[:-1], F.col("budget").alias("given"))
            dealt = caps.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).join(above, names[:-1])
        dealt = _dealt(dealt, names[:-1], _weight(weights, level))
    whole = F.expr("case when tokens > 0 then budget div tokens else 0 end")
    return dealt.select(*LEVELS, "tokens", "budget", whole.alias("whole")).withColumn("rest", F.expr("budget - whole * tokens"))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, int] | None = None,
    share: Fraction = Fraction(1, 2),
    epochs: int = 2,
    seed: int = 0,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, domain, lang, source, n_tokens, copies (how often it is taken)."""
    rows = materialise(measured(docs, domain, words(F.col("text")) if tokens is None else tokens), "mix-rows")
    leaves = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = materialise(budgets(leaves, weights or {}, share, epochs), "mix-budgets").select(*LEVELS, "whole", "rest")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(plan, list(LEVELS)).withColumn("at", order).withColumn("slice", F.substring("at", 1, SLICE_DIGITS))
    along = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(along), F.lit(0)))
    met = placed.join(materialise(slices, "mix-slices"), [*LEVELS, "slice"])
    inside, beyond = F.col("before") + F.col("held") <= F.col("rest"), F.col("before") > F.col("rest")
    taken = met.where(inside | beyond).withColumn("extra", inside.cast("long"))
    running = Window.partitionBy(*LEVELS, "slice").orderBy("at", "n_tokens", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    edge = met.where(~inside & ~beyond).withColumn("extra", (F.col("before") + F.sum("n_tokens").over(running) <= F.col("rest")).cast("long"))
    return taken.unionByName(edge).select("doc_id", "text_key", *LEVELS, "n_tokens", (F.col("whole") + F.col("extra")).alias("copies"))


def taken_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it; all columns as they were."""
    from .exact import keep_rows

    total = mixed.where("copies > 0").groupBy("doc_id", "text_key").agg(F.sum("copies").cast("int").alias("_copies"))
    each = keep_rows(docs, total, "_copies").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return each.select(*docs.columns)
