"""Row numbers over groups of any size.

``row_number() over (partition by project order by key)`` sorts a whole project in one task.
Here rows are range-partitioned by group and order, numbered inside each partition, and
shifted by the counts of the partitions before it, so a group may span any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.session import durable


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank",
                 total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size on request.

    ``order`` must be unique within a group for a reproducible result.  Runs one job: the
    partition numbering is written to the checkpoint folder so that retries agree on it.
    """
    placed = durable(
        df.repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id()))
    # One row per group and slice it touches: as many as there are groups, plus one per slice.
    sizes = placed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sizes.select(
        *group, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []))
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = placed.withColumn("_at", F.row_number().over(within))
    return (
        numbered.join(offsets, [*group, "_slice"])
        .withColumn(rank, (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_slice", "_before", "_at"))


def batch_candidates(candidates: DataFrame, n: int = 25) -> DataFrame:
    """Number the candidate keys of each project in batches of ``n`` in key order."""
    ranked = grouped_rank(candidates, ["project"], [F.col("key")])
    return ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / n).cast("bigint")).drop("rank")


def task_sequence(tasks: DataFrame) -> DataFrame:
    """Position and total of each task in its project, by locale then key."""
    return grouped_rank(tasks, ["project"], [F.col("locale"), F.col("key")], rank="position", total="total")


def unique_archive_name(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Suffix rows that want the same archive ``name``: '', '-1', '-2' … past the attempts taken.

    ``wanted`` has ``name`` and an ``archive_key`` unique within it; ``taken`` has the ``name``
    and ``attempt`` of archives already written.
    """
    start = taken.groupBy("name").agg((F.max("attempt") + 1).alias("_start"))
    ranked = grouped_rank(wanted, ["name"], [F.col("archive_key")]).join(start, "name", "left")
    attempt = F.coalesce(F.col("_start"), F.lit(0)) + F.col("rank") - 1
    return ranked.withColumn("attempt", attempt.cast("bigint")).withColumn(
        "archive_name",
        F.when(F.col("attempt") == 0, F.col("name"))
        .otherwise(F.concat_ws("-", "name", F.col("attempt").cast("string")))).drop("rank", "_start")
