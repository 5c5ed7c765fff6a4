"""The audit trail as an append-only JSON-lines dataset, and as a table of versions laid out by day.

Batch writers add files to the folder itself; each stream writes one sub-folder per
micro-batch. Readers take the folder with all its sub-folders, so both may share it.

An ``AuditTrail`` is for long trails: every file holds entries of one day, readers of a span of days open no other
files, small files are put together, and retention moves whole files to an archive.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.sources.policy import LONG, TEXT, struct
from palisade.sources.snapshots import Published, SnapshotTable, VersionTaken

# ``seq`` orders entries of equal timestamp; timestamps are UTC wall clock.
AUDIT_SCHEMA = struct(
    seq=LONG, timestamp=T.TimestampNTZType(), agent_id=TEXT, source=TEXT, action=TEXT, resource=TEXT,
    row_count=LONG, policy_decision=TEXT, duration_ms=LONG,
)


# microseconds, which the JSON writer would otherwise cut to milliseconds
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_READ = _TIMES | {"recursiveFileLookup": "true"}


def audit_columns(df: DataFrame) -> DataFrame:
    """Exactly the audit columns, typed; missing ones become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in AUDIT_SCHEMA.fields
        ]
    )


def append_audit(entries: DataFrame, path: str) -> None:
    audit_columns(entries).write.mode("append").options(**_TIMES).json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).options(**_READ).json(path)


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_SCHEMA).options(**_READ).json(path)


def append_audit_stream(entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly-once append: a micro-batch that is run again after a restart writes its own
    sub-folder (named by checkpoint and batch) anew."""
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").options(**_TIMES).json(f"{path}/stream-{stream}/batch-{batch_id:012d}")

    writer = audit_columns(entries).writeStream.outputMode("append")
    writer = writer.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


_DAY = re.compile(r"/part_day=(\d{4}-\d\d-\d\d)/")


def _day(name: str) -> date | None:
    """The day whose entries a file holds; None for entries without a time."""
    found = _DAY.search(name)
    return date.fromisoformat(found[1]) if found else None


class AuditTrail(SnapshotTable):
    """A trail whose files hold one day each. ``append`` takes batches and, once each, batches of named streams."""

    @staticmethod
    def open(spark: SparkSession, path: str) -> AuditTrail:
        trail = AuditTrail(spark, path)
        if not trail.versions():
            try:
                trail._publish(1, (), (), AUDIT_SCHEMA)
            except VersionTaken:
                pass
        return trail

    def append(self, entries: DataFrame, stream: str | None = None, batch: int | None = None) -> Published | None:
        return super().append(audit_columns(entries), stream, batch)

    def _write(self, df: DataFrame, folder: str) -> None:
        # equal ranges of time: a day with most entries is written by several tasks, and each task meets few days
        ordered = df.repartitionByRange("timestamp", "seq").withColumn("part_day", F.col("timestamp").cast("date"))
        ordered.write.partitionBy("part_day").parquet(folder)

    def read_span(self, since: datetime, until: datetime) -> DataFrame:
        """Entries with since <= timestamp < until; files of other days are not opened."""
        names = [n for n in self.files() if (d := _day(n)) is not None and since.date() <= d <= until.date()]
        at = F.col("timestamp")
        return self._frame(names).where((at >= F.lit(since).cast("timestamp_ntz")) & (at < F.lit(until).cast("timestamp_ntz")))

    def retain(self, since: datetime, archive: AuditTrail) -> int:
        """Move the entries from before ``since`` to ``archive``, each exactly once whatever dies on the way; entries without a time
        stay. Files of whole days go as they are read, only the day of ``since`` itself is parted. Returns the number
        of files moved or parted.

        What is to go is written down first. A run that finds such a note ends that move before its own.
        """
        moved = self._finish(archive)
        live = self.files()
        whole = [n for n in live if (d := _day(n)) is not None and d < since.date()]
        parted = [n for n in live if _day(n) == since.date()]
        if not whole and not parted:
            return moved
        self._note({"id": uuid.uuid4().hex, "since": since.isoformat(), "whole": whole, "parted": parted})
        return moved + self._finish(archive)

    def _finish(self, archive: AuditTrail) -> int:
        note = self._noted()
        if note is None:
            return 0
        since, files = F.lit(datetime.fromisoformat(note["since"])).cast("timestamp_ntz"), [*note["whole"], *note["parted"]]
        parted = self._frame(note["parted"])
        archive.append(self._frame(note["whole"]).unionByName(parted.where(F.col("timestamp") < since)), f"moved from {self.path}: {note['id']}", 0)
        while set(files) & set(self.files()):
            version = self.version()
            try:
                self._publish(version + 1, files, self._store(parted.where(F.col("timestamp") >= since)) if note["parted"] else ())
            except VersionTaken:
                continue
        self._at("manifests/moving.json").getFileSystem(self._conf()).delete(self._at("manifests/moving.json"), False)
        return len(files)

    def _note(self, note: dict) -> None:
        """One move at a time: a second one is refused while the first one's note is there."""
        waiting = self._at(f"manifests/waiting-{uuid.uuid4().hex}")
        out = waiting.getFileSystem(self._conf()).create(waiting, False)
        out.write(json.dumps(note).encode())
        out.close()
        self._rename(waiting, self._at("manifests/moving.json"), self.version())

    def _noted(self) -> dict | None:
        note = self._at("manifests/moving.json")
        if not note.getFileSystem(self._conf()).exists(note):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/moving.json", wholetext=True).collect()))
