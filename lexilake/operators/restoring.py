"""Before-images of managed files and the way back to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose
from lexilake.session import shuffled


def managed_files(*path_frames: DataFrame) -> DataFrame:
    """Distinct union of the paths a run may touch."""
    paths = path_frames[0].select("project", "path")
    for frame in path_frames[1:]:
        paths = paths.unionByName(frame.select("project", "path"))
    return paths.distinct()


def snapshot_tables(files: DataFrame, managed: DataFrame, history_id: str) -> DataFrame:
    """Content of every managed path now; NULL where there is no file."""
    return managed.join(shuffled(files.select("project", "path", "content")), ["project", "path"], "left").select(
        F.lit(history_id).alias("history_id"), "project", "path", "content")


def restore_as_of(snapshots: DataFrame, current: DataFrame, history: DataFrame,
                  history_id: str) -> tuple[DataFrame, DataFrame]:
    """What each snapshot file of ``history_id`` needs now, and projects where the id is unknown.

    Files the snapshot does not name are left alone.  A project takes part only if its history
    holds the id.
    """
    known = history.filter(F.col("id") == history_id).select("project").distinct()
    wanted = snapshots.filter(F.col("history_id") == history_id).join(known, "project", "left_semi").select(
        "project", "path", "content")
    now = current.select("project", "path", F.col("content").alias("_now"))
    action = (
        F.when(F.col("content").isNull() & F.col("_now").isNull(), "keep")
        .when(F.col("content").isNull(), "delete")
        .when(F.col("content").eqNullSafe(F.col("_now")), "keep")
        .otherwise("write"))
    plan = wanted.join(shuffled(now), ["project", "path"], "left").withColumn("action", action).drop("_now")
    unknown = snapshots.select("project").distinct().join(known, "project", "left_anti")
    return plan, diagnose(unknown, "L10N_E0062", {"history_id": F.lit(history_id)})
