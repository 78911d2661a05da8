"""Streams with state of their own: runs that stall, reported by timer, and upserts that a replay does not repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lexilake.operators.applying import upsert_entries
from lexilake.session import durable, forget, ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALLED = "project int, started_at timestamp, stalled_at timestamp, reports bigint"


def merge_sessions(sessions: list[tuple[int, int, int]], times: list[int], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, reports) with more reports: those less than ``gap`` apart, or just that, are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*sessions, *((t, t, 1) for t in times)]):
        if out and first <= out[-1][1] + gap:
            a, b, m = out[-1]
            out[-1] = (a, max(b, last), m + n)
        else:
            out.append((first, last, n))
    return out


class RunWatch(StatefulProcessor):
    """Open sessions of a project's reports, with one timer at the time when the first of them counts as stalled.

    Times are microseconds; timers have milliseconds and fire no earlier.  A timer for each session would make the work
    of a project grow with the square of its sessions, as each one that fires reads and writes them all.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, reports bigint")

    def _sessions(self) -> list[tuple[int, int, int]]:
        return [tuple(row) for row in self.open.get()] if self.open.exists() else []

    def _due(self, session: tuple[int, int, int]) -> int:
        return -(-(session[1] + self.gap) // 1000)

    def _store(self, sessions: list) -> None:
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()

    def _set_timer(self, old: int | None, sessions: list) -> None:
        new = min(map(self._due, sessions), default=None)
        if new == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t) for pdf in rows for t in pdf["micros"]]
        before = self._sessions()
        after = merge_sessions(before, times, self.gap)
        self._store(after)
        self._set_timer(min(map(self._due, before), default=None), after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = self._sessions()
        done = [s for s in before if self._due(s) <= now]
        rest = [s for s in before if self._due(s) > now]
        self._store(rest)
        # The timer that fired is gone.
        self._set_timer(None, rest)
        at = lambda micros: pd.to_datetime(micros, unit="us", utc=True)
        if done:
            yield pd.DataFrame({
                "project": [key[0]] * len(done), "started_at": at([s[0] for s in done]),
                "stalled_at": at([s[1] + self.gap for s in done]), "reports": [s[2] for s in done]})

    def close(self) -> None:
        pass


def watch_runs(states: DataFrame, gap_minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """(project, started_at, stalled_at, reports): a row for each run once no report came for the gap, in append mode.

    State is a project's open sessions, whose timer fires when the watermark passes the gap after the last report of one,
    also for projects that send nothing any more.  Reports are kept as sessions, never one by one, and a session goes when
    it is reported.  Start the stream by ``start_with_state``.
    """
    ship_package(states.sparkSession)
    timed = states.select("project", F.col("updated_at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return timed.withColumn("micros", F.unix_micros("at")).groupBy("project").transformWithStateInPandas(
        RunWatch(gap_minutes * 60_000_000), STALLED, "Append", "EventTime")


def start_with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a stream whose state store has timers; the session's own setting stands again once it has started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


LEDGER = "_ledger"


def upsert_into(spark: SparkSession, path: str, new: DataFrame, batch_id: int) -> bool:
    """Bring the rows of one micro-batch into the entry table at ``path``, once.

    The table has a folder for each project and locale; only those that the batch touches are read and replaced.  The
    ledger beside them names the batches that are in.  One that is there already changes nothing.  One that was cut
    short before its ledger row is done again: its rows replace themselves.
    """
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{LEDGER}/batch={batch_id}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return False
    fresh = durable(new)
    table = spark.read.parquet(path)
    touched = fresh.select("project", "locale").distinct()
    current = table.join(touched, ["project", "locale"], "left_semi").select(*fresh.columns)
    merged = durable(upsert_entries(current, fresh))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "locale").parquet(path)
    fresh.groupBy("project", "locale").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
        f"{path}/{LEDGER}/batch={batch_id}")
    forget(fresh, merged)
    return True


def upsert_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of entries, each key once in a batch, into the table at ``path``."""
    return rows.writeStream.foreachBatch(lambda batch, batch_id: upsert_into(batch.sparkSession, path, batch, batch_id) and None).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
