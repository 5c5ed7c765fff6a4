"""Governed writes: explicit targets, an approval gate, copy-on-write results.

Writes see raw tables, but only rows and columns in the agent's reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.querytext import WRITES
from palisade.operators.enforce import Access, AccessDenied, ResidencyKey, in_reach, own_reach
from palisade.session import materialise
from palisade.sources.snapshots import Published, SnapshotTable


def gate_writes(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """The allowed write requests with ``released``: false while an approval is needed and no
    approval row names the request. ``requests`` carries request_id, operation and decision."""
    writes = requests.filter(F.col("decision.allowed") & F.col("operation").isin(*WRITES))
    granted = approvals.select("request_id").distinct().withColumn("_granted", F.lit(True))
    judged = writes.join(granted, "request_id", "left")
    free = ~F.col("decision.requires_approval") | F.col("_granted").isNotNull()
    return judged.select(*requests.columns, free.alias("released"))


def require_approval(access: Access, operation: str, approved: bool | DataFrame) -> None:
    """``approved`` is a caller's word, or a table of approvals (agent, source, table, operation)
    that must name this write."""
    if not access.requires_approval:
        return
    if isinstance(approved, DataFrame):
        wanted = {"agent": access.agent, "source": access.source, "operation": operation}
        named = reduce(and_, [F.col(c) == v for c, v in wanted.items()]) & (F.lower("table") == access.table.lower())
        approved = not approved.filter(named).isEmpty()
    if not approved:
        raise AccessDenied(
            "approval_required",
            f"Write operation blocked: {operation} on {access.source}.{access.table} requires approval.",
        )


def _in_scope(columns: Iterable[str], access: Access) -> None:
    fields = None if list(access.fields or []) == ["*"] else access.fields
    outside = [c for c in columns if fields and c.lower() not in {f.lower() for f in fields}]
    if outside:
        raise AccessDenied("scope_denied", f"Columns outside the scope: {', '.join(outside)}")


def _readable(table: DataFrame, expressions: Iterable[Column], access: Access) -> None:
    """What assignments and conditions read must be columns the agent may see unmasked: else a
    write could copy a masked value into an open column, or betray it by the rows it hits."""
    plan = table.select(*expressions)._jdf.queryExecution().analyzed()
    if plan.subqueriesAll().size():
        raise AccessDenied("scope_denied", "Subqueries are not allowed in a governed write")
    names = plan.references().toSeq()
    read = list(dict.fromkeys(names.apply(i).name() for i in range(names.size())))
    _in_scope(read, access)
    hidden = {p["name"].lower() for p in access.columns if p["masking"] != "none"}
    masked = [c for c in read if c.lower() in hidden]
    if masked:
        raise AccessDenied("governance_denied", f"Masked columns may not be read by a write: {', '.join(masked)}")


class Inserted(NamedTuple):
    """Rows to append, and rows the agent could not read back; together all that were given."""

    accepted: DataFrame
    rejected: DataFrame


def governed_insert(
    table: DataFrame,
    rows: DataFrame,
    access: Access,
    *,
    approved: bool | DataFrame = False,
    residency: ResidencyKey | None = None,
) -> Inserted:
    """Rows in the table's shape, parted by reach, as the row filter governs writes as well.
    Columns outside the scope stay NULL."""
    require_approval(access, "INSERT", approved)
    _in_scope(rows.columns, access)
    given = {c.lower(): c for c in rows.columns}
    shaped = rows.select(
        *[
            (F.col(given[f.name.lower()]) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    whole, reach = in_reach(shaped, access, residency)
    return Inserted(whole.filter(reach).select(*table.columns), whole.filter(~reach).select(*table.columns))


def governed_update(
    table: DataFrame,
    assign: Mapping[str, Column],
    where: Column,
    access: Access,
    *,
    approved: bool | DataFrame = False,
    residency: ResidencyKey | None = None,
) -> DataFrame:
    """The table after the update: a row changes only where the condition is true and the
    row is in reach. One narrow pass over the table.

    A row that would leave the agent's reach by the update makes the write fail, as such a row
    makes an insert fail; a residency that goes through a lookup may not be reassigned at all.
    """
    require_approval(access, "UPDATE", approved)
    _in_scope(assign, access)
    _readable(table, [*assign.values(), where], access)
    given = {c.lower(): v for c, v in assign.items()}
    if access.residency and residency is not None and residency.via is not None and residency.column.lower() in given:
        raise AccessDenied("governance_denied", f"{residency.column} decides the residency and may not be reassigned")
    whole, reach = in_reach(table, access, residency)
    hit = whole.withColumn("_hit", reach & F.coalesce(where, F.lit(False)))
    helpers = [c for c in hit.columns if c not in table.columns]
    changed = hit.select(
        *[
            F.when(F.col("_hit"), given[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name.lower() in given
            else F.col(f.name)
            for f in table.schema.fields
        ],
        *helpers,
    )
    stays = own_reach(changed, access, residency)
    lost = F.raise_error(F.lit(f"update of {access.source}.{access.table} would move rows out of the agent's reach"))
    return changed.select(
        *[
            F.when(~F.col("_hit") | stays, F.col(f.name)).otherwise(lost).alias(f.name)
            if f.name.lower() in given
            else F.col(f.name)
            for f in table.schema.fields
        ]
    )


def governed_delete(
    table: DataFrame,
    where: Column,
    access: Access,
    *,
    approved: bool | DataFrame = False,
    residency: ResidencyKey | None = None,
) -> DataFrame:
    """The table after the delete: a row goes only where the condition is true, not unknown."""
    require_approval(access, "DELETE", approved)
    _readable(table, [where], access)
    whole, reach = in_reach(table, access, residency)
    return whole.filter(~(reach & F.coalesce(where, F.lit(False)))).select(*table.columns)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Store the state after a write as a new snapshot; the old one stays until dropped."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


Change = Callable[[DataFrame], DataFrame]


def rewrite_partitions(table: DataFrame, where: Column, change: Change, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions of a stored table (parquet under ``path``) that a change touches.

    ``change`` (say, a governed update or delete) gets all rows of those partitions: the ones
    that hold a row ``where`` is true for, and, if it moves rows, the ones it moves them to. Their
    values are fetched (as many as partitions are touched), so the scan prunes all others. The
    new rows are stored beside the table first, then swapped in; a partition left without rows
    goes. ``where`` must be true for every row that ``change`` alters. The swap is not atomic: where a
    crash or a reader may come in between, keep a ``SnapshotTable``.
    """
    spark, by = table.sparkSession, list(partition_by)
    found = _values(table.filter(where), by)
    if not found:
        return
    moved = _values(change(table.filter(_among(found, by)).filter(where)), by)
    touched = list(dict.fromkeys([*found, *moved]))
    after = materialise(change(table.filter(_among(touched, by))), "rewritten")
    left = set(_values(after, by))
    writer = after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)
    emptied = [v for v in touched if v not in left]
    if emptied:
        _remove_files(spark.read.schema(table.schema).parquet(path).filter(_among(emptied, by)))


def _values(df: DataFrame, by: Sequence[str]) -> list[tuple]:
    return [tuple(r) for r in df.select(*by).distinct().collect()]


def _among(values: Sequence[tuple], by: Sequence[str]) -> Column:
    """Literal tests, so that the scan prunes partitions."""
    if not values:
        return F.lit(False)
    if len(by) == 1:
        known = [v[0] for v in values if v[0] is not None]
        test = F.col(by[0]).isin(*known) if known else F.lit(False)
        return (test | F.col(by[0]).isNull()) if len(known) < len(values) else test
    each = [reduce(and_, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(by, v, strict=True)]) for v in values]
    return reduce(or_, each)


def _remove_files(stale: DataFrame) -> None:
    """Delete the files that hold the rows of partitions which the change has emptied."""
    spark = stale.sparkSession
    for row in stale.select(F.col("_metadata.file_path").alias("name")).distinct().collect():
        file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["name"]))
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)


def update_table(
    stored: SnapshotTable, assign: Mapping[str, Column], where: Column, access: Access, **options
) -> Published | None:
    """``governed_update`` of a table of versions: only files that hold a row the update hits are written again, and the new
    state is published at once or not at all. None if no row is hit."""
    return _rewritten(stored, where, access, lambda rows: governed_update(rows, assign, where, access, **options), **options)


def delete_from_table(stored: SnapshotTable, where: Column, access: Access, **options) -> Published | None:
    """``governed_delete`` of a table of versions, as ``update_table``."""
    return _rewritten(stored, where, access, lambda rows: governed_delete(rows, where, access, **options), **options)


def insert_into_table(
    stored: SnapshotTable, rows: DataFrame, access: Access, **options
) -> tuple[Published, DataFrame]:
    """Appends what ``governed_insert`` accepts, as one version; also returns the rejected rows."""
    parts = governed_insert(stored.read(), rows, access, **options)
    return stored.append(parts.accepted), parts.rejected


def _rewritten(
    stored: SnapshotTable, where: Column, access: Access, change: Change, *, residency: ResidencyKey | None = None, **_
) -> Published | None:
    table = stored.read()
    change(table)  # what is refused is refused before any file is looked at
    if not access.residency or (residency is not None and residency.via is None):
        where = own_reach(table, access, residency) & where
    return stored.rewrite(where, change)


def append_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
