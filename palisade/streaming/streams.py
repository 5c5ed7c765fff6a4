"""The same operators over streams.

Policies are static tables joined to the stream, so a decision needs no state; tumbling
counts keep one number per agent and open window. Windows are written as they change
(``run_to_windows``), so a drained run has delivered all of them, open ones included. Rows
later than the watermark are not counted in; ``late_rows`` tells how many there were.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from palisade.operators.audit import audit_of_outcomes, peaks_judged, quota_breaches, quota_windows, rate_windows
from palisade.operators.enforce import Access, ResidencyKey, govern
from palisade.plans.outcome import request_outcome
from palisade.sources.policy import Bundle
from palisade.sources.snapshots import SnapshotTable, VersionTaken


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """Landed files as a stream; ``path`` may be a folder or a pattern."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


_EPOCH = "1970-01-01 00:00:00"


def _watermarked(audit: DataFrame, lateness: str) -> DataFrame:
    """Watermarks need an instant: the UTC wall clock of the trail, read as one."""
    wall = F.col("timestamp").cast("timestamp_ntz")
    instant = F.lit(f"{_EPOCH}Z").cast("timestamp") + (wall - F.lit(_EPOCH).cast("timestamp_ntz"))
    return audit.withColumn("timestamp", instant).withWatermark("timestamp", lateness)


def _wall(windows: DataFrame) -> DataFrame:
    start = F.lit(_EPOCH).cast("timestamp_ntz") + (F.col("window_start") - F.lit(f"{_EPOCH}Z").cast("timestamp"))
    return windows.withColumn("window_start", start)


def stream_rate_limit(
    audit: DataFrame, most: int = 100, length: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """Windows in which an agent sent more than ``most`` requests."""
    return _wall(rate_windows(_watermarked(audit, lateness), length)).filter(F.col("requests") > most)


def stream_row_quota(
    audit: DataFrame, bundle: Bundle, length: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Windows in which an agent received more rows than its cap."""
    return quota_breaches(_wall(quota_windows(_watermarked(audit, lateness), length)), bundle)


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PEAKS = "agent_id string, peak long"


def _peak_rows(agents: list, peaks: list) -> pd.DataFrame:
    return pd.DataFrame({"agent_id": pd.Series(agents, dtype=object), "peak": pd.Series(peaks, dtype="int64")})


#: Microseconds of one piece of the waiting steps, and entries that a task takes up before it stores them.
_HOUR = 3_600_000_000
_ENTRIES = 1 << 20


def _net(t: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants in order, each once, and the net step of each; without those that come to nothing."""
    order = np.argsort(t, kind="stable")
    t, step = t[order], step[order]
    first = np.flatnonzero(np.diff(t, prepend=t[:1] - 1))
    net = np.add.reduceat(step, first) if len(t) else step
    return t[first][net != 0], net[net != 0]


class _Levels(StatefulProcessor):
    """One agent's running level. Steps up to the watermark are folded into ``level``, with the highest one so far; later
    ones wait in ``hours``, net per instant, as entries that come may still stand before them. An hour is read and written as
    a whole, so state is touched once an hour and ``_ENTRIES`` entries, and memory holds no more than those."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level long, peak long, until long")
        self.hours = handle.getMapState("hours", "hour long", "t binary, net binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names that Spark calls)
        until = (self.level.get() or (0, 0, -1 << 62))[2]
        held, n = [], 0
        for batch in rows:
            spans = batch[["start", "end"]].to_numpy("int64")
            held.append(spans[spans[:, 0] >= until])  # else it is later than what has been folded already
            n += len(held[-1])
            if n >= _ENTRIES:
                self._store(np.concatenate(held))
                held, n = [], 0
        if n:
            self._store(np.concatenate(held))
        yield _peak_rows([key[0]], [self._folded(timerValues)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._folded(timerValues)
        yield _peak_rows([], [])

    def _waiting(self, hour: int) -> tuple[np.ndarray, np.ndarray]:
        t, net = self.hours.getValue((hour,))
        return np.frombuffer(t, "int64"), np.frombuffer(net, "int64")

    def _put(self, hour: int, t: np.ndarray, net: np.ndarray) -> None:
        if len(t):
            self.hours.updateValue((hour,), (t.tobytes(), net.tobytes()))
        else:
            self.hours.removeKey((hour,))

    def _store(self, spans: np.ndarray) -> None:
        """Add the steps of new entries to those that wait."""
        t, net = _net(spans.T.ravel(), np.repeat(np.array([1, -1]), len(spans)))
        hours, first = np.unique(t // _HOUR, return_index=True)
        for hour, a, b in zip(hours.tolist(), first.tolist(), [*first[1:].tolist(), len(t)], strict=True):
            if self.hours.containsKey((hour,)):
                old = self._waiting(hour)
                self._put(hour, *_net(np.append(old[0], t[a:b]), np.append(old[1], net[a:b])))
            else:
                self._put(hour, t[a:b], net[a:b])

    def _folded(self, timers) -> int:
        """Fold what the watermark has passed; keep, and set a timer for, what it has not. The highest level as things stand:
        an entry that comes can only raise it."""
        mark = timers.getCurrentWatermarkInMs() * 1000
        level, peak, until = self.level.get() or (0, 0, -1 << 62)
        now, top, last = level, peak, None
        for hour in sorted(k[0] for k in self.hours.keys()):
            t, net = self._waiting(hour)
            levels = now + np.cumsum(net)
            passed = int(np.searchsorted(t, mark, "right"))
            if passed:
                level, peak = int(levels[passed - 1]), max(peak, int(levels[:passed].max()))
                self._put(hour, t[passed:], net[passed:])
            if passed < len(t):
                last = int(t[-1])
            now, top = int(levels[-1]), max(top, int(levels.max()))
        self.level.update((level, peak, max(until, mark)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return top

    def close(self) -> None:
        pass


def stream_peak_concurrency(audit: DataFrame, bundle: Bundle, lateness: str = "10 minutes") -> DataFrame:
    """(agent_id, peak, max_concurrency, breached) as entries arrive, the batch answer once all have: overlapping [start, start +
    duration) of each agent. State holds the steps the watermark has not passed; entries later than it are left out.
    Sets the session's state store to RocksDB, which this state needs."""
    audit.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    timed = _watermarked(audit.filter("duration_ms is not null and duration_ms > 0 and timestamp is not null"), lateness)
    start = F.unix_micros("timestamp")
    spans = timed.select("agent_id", "timestamp", start.alias("start"), (start + F.col("duration_ms") * 1000).alias("end"))
    peaks = spans.groupBy("agent_id").transformWithStateInPandas(_Levels(), _PEAKS, "update", "EventTime")
    return peaks_judged(peaks, bundle)


def stream_decisions(requests: DataFrame, bundle: Bundle, **options) -> DataFrame:
    """Outcome of each request as it arrives. Policies are the static side of every join; for
    stored ones, ``lookups.resolve`` and ``scope.resolve_scopes`` once ahead keep the
    micro-batches from working the lookups out again."""
    return request_outcome(requests, bundle, **options)


def stream_audit_entries(requests: DataFrame, bundle: Bundle, **options) -> DataFrame:
    return audit_of_outcomes(stream_decisions(requests, bundle, **options))


def stream_governed(df: DataFrame, access: Access, residency: ResidencyKey | None = None, **options) -> DataFrame:
    """A governed stream: filters, masks and scope columns, without the per-query row cap."""
    return govern(df, access, residency=residency, **options).df


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", **trigger):
    """Start writing a stream to files (exactly once, restartable from the checkpoint)."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


_WRITTEN = ("_run", "_batch")


def run_to_windows(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing windows in update mode to a table of versions (``SnapshotTable``) that several streams and runs may share.
    Every micro-batch appends the windows it changed, once, however often it is run; ``read_windows`` shows the last
    state of each, ``fold_windows`` keeps only that."""
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    run = time.time_ns() // 1000
    spark = df.sparkSession
    target = SnapshotTable(spark, path)
    if not target.versions():
        columns = [*df.schema.fields, *[StructField(c, LongType()) for c in _WRITTEN]]
        with contextlib.suppress(VersionTaken):  # another stream was first
            SnapshotTable.create(spark.createDataFrame([], StructType(columns)), path)

    def store(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumns({"_run": F.lit(run).cast("long"), "_batch": F.lit(batch_id).cast("long")})
        target.append(named, stream, batch_id)

    writer = df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_windows(spark: SparkSession, path: str, schema, keys: Sequence[str] = ("agent_id", "window_start")) -> DataFrame:
    """The last state of each window written by ``run_to_windows``."""
    return _last(SnapshotTable(spark, path).read(), keys).select(*schema.names)


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, *_WRITTEN)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*_WRITTEN, *others)).alias("last"))
    return last.select(*keys, *[f"last.{c}" for c in (*others, *_WRITTEN)])


def fold_windows(spark: SparkSession, path: str, keys: Sequence[str] = ("agent_id", "window_start"), keep: int = 10) -> None:
    """Keep only the last state of each window, beside running streams too; files that only versions before the last ``keep`` read go
    when they are a day old."""
    target = SnapshotTable(spark, path)
    while True:
        version = target.version()
        with contextlib.suppress(VersionTaken):
            target.replace(_last(target.read(version), keys), version)
            break
    target.vacuum(keep)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, as far as progress is kept."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def drain(query: StreamingQuery) -> None:
    """Wait for a bounded (availableNow) run and surface its failure."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
