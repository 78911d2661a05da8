"""Archives of removed locales and of reviewed entries that lost their key; file snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.operators.ranking import unique_archive_name


def archive_stamp(now: Column) -> Column:
    return F.date_format(now, "yyyyMMddHHmmss")


def name_archives(removed: DataFrame, now: Column, taken: DataFrame, prefix: str = "") -> DataFrame:
    """Give each removed catalog (project, locale) an archive name nothing holds yet.

    Names are ``<prefix><locale>-<14 digits>`` with a numbered suffix on collision.  Rows of one
    catalog share a name; catalogs of different projects collide and are numbered.
    """
    catalogs = removed.select("project", "locale").distinct().select(
        "project", "locale", F.concat(F.lit(prefix), F.col("locale"), F.lit("-"), archive_stamp(now)).alias("name"),
        F.format_string("%010d", F.col("project")).alias("archive_key"))
    named = unique_archive_name(catalogs, taken)
    return removed.join(named.select("project", "locale", "name", "attempt", "archive_name"), ["project", "locale"])


def archive_removed(removed: DataFrame, now: Column, taken: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """Write removed rows under their archive names and return them with those names."""
    named = name_archives(removed, now, taken, prefix)
    named.withColumn("archive_id", F.col("archive_name")).write.mode("append").partitionBy("archive_id").parquet(path)
    return named


def write_snapshot(rows: DataFrame, path: str) -> None:
    """One partition per history id, so a restore reads only its own."""
    rows.write.mode("append").partitionBy("history_id").parquet(path)
