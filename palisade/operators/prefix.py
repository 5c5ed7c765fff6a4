"""Running sums over time that stay parallel when one key, or one minute, holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from palisade.session import materialise


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    value: str,
    name: str,
    pieces: int | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all earlier rows and this one, per key, in
    (ts, order) order, which must be total.

    The rows are cut into equal ranges of (keys, ts, order), whatever the keys and times, and
    stored, so that every later read sees the same ranges. Sums of a key in each range are
    accumulated (at most as many as there are ranges), and a window adds up inside a range.
    """
    pieces = pieces or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranges = df.repartitionByRange(pieces, *keys, ts, *order).withColumn("_range", F.spark_partition_id())
    # one struct key: equal also where a key is NULL
    rows = materialise(ranges.withColumn("_group", F.struct(*keys, "_range")), "ranges")
    sums = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[f"_group.{k}" for k in keys]).orderBy("_group._range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_group").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, "_group").withColumn(name, F.col("_start") + F.sum(value).over(inside))
    return out.select(*df.columns, name)


def peak_level(net: DataFrame, key: str, t: str, step: str) -> DataFrame:
    """(key, peak): the highest running sum of ``step`` over time, for one row per (key, t)."""
    levels = running_sum(net, [key], t, [], step, "_level")
    return levels.groupBy(key).agg(F.max("_level").alias("peak"))


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    value: str,
    name: str,
    pieces: int | None = None,
) -> DataFrame:
    """Add ``name`` = ``value`` (never NULL) of the last row of ``right`` with the same keys and ``since`` <= ``at``.

    ``right`` has one row for each (keys, since). Both sides are put in one order and cut into equal ranges, as in
    ``running_sum``; the last value goes along inside a range, and from each range to the next ones of its key.
    """
    pieces = pieces or max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    time, kind = right.schema[since].dataType, right.schema[value].dataType
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])  # parts rows of one key and time
    asked = left.select(
        F.struct(*keys).alias("_key"), F.col(at).cast(time).alias("_t"), F.lit(1).alias("_side"), spread.alias("_spread"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).cast(kind).alias("_value"),
    )
    known = right.dropna(subset=list(keys)).select(
        F.struct(*keys).alias("_key"), F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_spread"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"),
    )
    both = known.unionByName(asked).repartitionByRange(pieces, "_key", "_t", "_side", "_spread")
    rows = materialise(both.withColumn("_group", F.struct("_key", F.spark_partition_id().alias("_range"))), "asof")
    last = rows.groupBy("_group").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy("_group._key").orderBy("_group._range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_group", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_group").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(carried, "_group").withColumn("_found", F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_carried"))
    return met.where("_side = 1").select("_row.*", F.col("_found").alias(name))
