"""Findings in one order, across files of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.session import durable, forget

ORDER = ["code", "project", "locale", "key", "path"]


def numbered_findings(diags: DataFrame) -> DataFrame:
    """The findings with ``position``, from 1, in order of code, project, locale, key, path and details.

    Rows are dealt in ranges with sampled bounds and numbered inside each; what the ranges before hold is added.  Equal
    findings are interchangeable, so the numbering is the same whenever it is made.  They are stored before they are dealt,
    as the sample of the bounds would make them all once more.
    """
    details = F.to_json(F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>")))))
    order = [F.asc_nulls_first(c) for c in [*ORDER, "_details"]]
    made = durable(diags.withColumn("_details", details))
    placed = durable(made.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    forget(made)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_at", inside).join(starts, "_range").select(
        (F.col("_before") + F.col("_at")).alias("position"), *diags.columns)


def write_report(diags: DataFrame, path: str) -> None:
    """Findings as JSON lines with their positions; the files in order of their names are the report in order."""
    rows = durable(numbered_findings(diags))
    rows.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").json(path)
    forget(rows)
