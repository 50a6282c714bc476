"""Change propagation: debounced rebuilds, version changes, and streams that commit a batch at a time.

Rebuilds and version changes come in two forms that give the same rows: over a table of what happened, and over a stream that keeps
a little state for each key, with timers where something must happen though nothing comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener


def debounced(events: DataFrame, key: str | None, ts: str, gap: str) -> DataFrame:
    """(key, fires_at, changes): a rebuild `gap` after the last of changes that lie less than it apart. For tables and for streams."""
    groups = [F.session_window(ts, gap).alias("w")] + ([F.col(key)] if key else [])
    return events.groupBy(*groups).agg(F.count("*").alias("changes")).select(*([key] if key else []), F.col("w.end").alias("fires_at"), "changes")


def debounced_stream(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """As debounced, for a stream whose events are at most `late` late. Timestamps without a zone are read as UTC."""
    return debounced(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), key, ts, gap)


def version_changes(polls: DataFrame) -> DataFrame:
    """Polls (source, polled_at, version) whose version differs from the one before, which isn't blank. The first poll is the base line."""
    known = polls.where(F.col("version") != "")
    before = F.lag("version").over(Window.partitionBy("source").orderBy("polled_at"))
    return known.withColumn("previous", before).where("previous is not null and previous <> version")


def on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run rebuild(rows, batch) for each batch of a stream of changes that isn't empty; without `every`, all there is now and then stop."""

    def commit(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            rebuild(rows, batch)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _keyed_state(spark: SparkSession) -> None:
    """Streams with state and timers need the RocksDB store; the session's setting is changed if it is still Spark's default."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Rebuilds(StatefulProcessor):
    """Of each key: when its rebuild and its refresh are due, and how many changes came since the last rebuild.

    A new change moves the due time; only the timer that meets it fires, so a burst makes one rebuild. A refresh puts off the next one
    by its own interval and leaves changes that wait to their rebuild.
    """

    def __init__(self, gap_ms: int, refresh_ms: int | None):
        self.gap, self.refresh = gap_ms, refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", "due bigint, changes bigint, refresh bigint")

    def _get(self) -> tuple[int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, (due, changes, refresh) = timerValues.getCurrentProcessingTimeInMs(), self._get()
        changes += sum(map(len, rows))
        if due:
            self.handle.deleteTimer(due)
        due = now + self.gap
        due += due == refresh  # a timer is known by its time, so the two never share one
        self.handle.registerTimer(due)
        if self.refresh and not refresh:
            refresh = now + self.refresh
            refresh += refresh == due
            self.handle.registerTimer(refresh)
        self.state.update((due, changes, refresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, (due, changes, refresh) = expiredTimerInfo.getExpiryTimeInMs(), self._get()
        if at == due:
            self.state.update((0, 0, refresh))
            yield pd.DataFrame({"key": [key[0]], "reason": ["change"], "fires_at": [pd.Timestamp(at, unit="ms")], "changes": [changes]})
        elif at == refresh:
            refresh = max(at, timerValues.getCurrentProcessingTimeInMs()) + self.refresh
            refresh += refresh == due
            self.handle.registerTimer(refresh)
            self.state.update((due, changes, refresh))
            yield pd.DataFrame({"key": [key[0]], "reason": ["refresh"], "fires_at": [pd.Timestamp(at, unit="ms")], "changes": [0]})

    def close(self) -> None:
        pass


def rebuilds(events: DataFrame, key: str, gap: float, refresh: float | None = None) -> DataFrame:
    """(key, reason, fires_at, changes) of a stream of changes: `change` once `gap` seconds passed without another one of its key, and `refresh` every `refresh` seconds from a key's first change on.

    Time is that of the clock, and timers fire in batches without any event too. The state of a key is three numbers.
    """
    _keyed_state(events.sparkSession)
    processor = _Rebuilds(round(gap * 1000), round(refresh * 1000) if refresh else None)
    keyed = events.select(F.col(key).cast("string").alias("key")).groupBy("key")
    return keyed.transformWithStateInPandas(processor, "key string, reason string, fires_at timestamp, changes bigint", "Append", "ProcessingTime")


class _Versions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("version", "version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = pd.concat(list(rows)).sort_values("polled_at", kind="stable")  # the polls of one source in one batch
        before = self.state.get()[0] if self.state.exists() else None
        previous = [before, *known.version][: len(known)]
        self.state.update((known.version.iloc[-1],))
        out = known.assign(previous=previous)
        yield out[[p is not None and p != v for p, v in zip(previous, known.version, strict=True)]]

    def close(self) -> None:
        pass


def version_changes_stream(polls: DataFrame) -> DataFrame:
    """As version_changes, for a stream whose polls of a source come in their order; a batch's own polls are put into order."""
    _keyed_state(polls.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polls.schema) + ", previous string"
    return polls.where("version <> ''").groupBy("source").transformWithStateInPandas(_Versions(), kinds, "Append", "None")


class StreamProgress(StreamingQueryListener):
    """Publishes (stage, detail, current, total) of the streams of a session after each of their batches: rows so far, and 0 as no total is known."""

    def __init__(self, publish: Callable[[str, str, int, int], None]):
        self.publish, self.rows = publish, {}

    def onQueryStarted(self, event) -> None:
        self.publish(event.name or str(event.id), "started", 0, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.id] = self.rows.get(p.id, 0) + p.numInputRows
        self.publish(p.name or str(p.id), f"batch {p.batchId}", self.rows[p.id], 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.publish(str(event.id), f"failed: {event.exception}" if event.exception else "ended", self.rows.get(event.id, 0), 0)
