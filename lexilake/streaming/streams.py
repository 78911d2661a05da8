"""History, progress, stalled runs and incremental staleness as streams.

Event times arrive as NTZ timestamps; watermarks need TIMESTAMP, so every job casts first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions.hashing import percent_complete
from lexilake.operators.applying import upsert_entries
from lexilake.operators.planning import plan_sync
from lexilake.schemas import HISTORY
from lexilake.session import shuffled


def history_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of rows; new files of JSON lines are picked up as they land."""
    return spark.readStream.schema(f"project int, line_no bigint, {HISTORY}").json(path)


def stream_history(log: DataFrame) -> DataFrame:
    """Rows and last time per project, for update or complete mode."""
    return log.groupBy("project").agg(
        F.count(F.lit(1)).alias("entries"), F.max_by("ts", "line_no").alias("last_at"))


def live_status(states: DataFrame) -> DataFrame:
    """Latest saved progress per project with percent and remainder."""
    done, planned = F.col("s.completed_translations"), F.col("s.total_translations")
    latest = states.groupBy("project").agg(F.max_by(
        F.struct("completed_translations", "total_translations", "status", "updated_at"),
        F.struct("updated_at", "completed_translations")).alias("s"))
    return latest.select(
        "project", done.alias("completed_translations"), planned.alias("total_translations"), "s.status",
        percent_complete(done, planned).alias("percent_complete"),
        F.greatest(F.lit(0), planned - done).alias("remaining"), "s.updated_at")


def stalled_runs(states: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of progress reports that ended because none came for ``gap``.

    In append mode a session appears once the watermark has passed its end.
    """
    timed = states.withColumn("at", F.col("updated_at").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", delay)
    return timed.groupBy("project", F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("reports")).select(
        "project", F.col("w.start").alias("started_at"), F.col("w.end").alias("stalled_at"), "reports")


def newest_versions(batch: DataFrame, version: str | None) -> DataFrame:
    """One row per project and key: that with the highest version; ties, and no version, go by content."""
    content = [c for c in ("source_hash", "text", "description") if c in batch.columns]
    order = ([version] if version else []) + content
    rest = [c for c in batch.columns if c not in ("project", "key")]
    # A struct with a map has no order, so the order comes apart from the row.
    return batch.groupBy("project", "key").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select("project", "key", "_row.*").select(*batch.columns)


def incremental_staleness(changes: DataFrame, read_tables: Callable[[], tuple], write_tasks: Callable,
                          checkpoint: str, version: str | None = None, deleted: str | None = None):
    """Re-plan only the keys that changed, one micro-batch at a time.

    ``changes`` streams source rows.  ``version`` names a column that orders the versions of a key and
    ``deleted`` one that marks rows whose key left the source; such keys have no tasks.  ``read_tables``
    gives (entries, locales, cache, configs) as they are now, ``write_tasks(tasks, batch_id)`` must be
    idempotent per batch id.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        newest = newest_versions(batch, version)
        if deleted:
            newest = newest.filter(~F.coalesce(F.col(deleted), F.lit(False)))
        newest = newest.drop(*[c for c in (version, deleted) if c])
        entries, locales, cache, configs = read_tables()
        touched = entries.join(shuffled(newest.select("project", "key")), ["project", "key"], "left_semi")
        write_tasks(plan_sync(newest, touched, locales, cache, configs), batch_id)

    return changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def upsert_batch(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The entry table after a micro-batch: replays change nothing."""
    return upsert_entries(entries, new)
