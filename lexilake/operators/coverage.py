"""Coverage and inventory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.session import shuffled


def locale_coverage(source: DataFrame, entries: DataFrame, locales: DataFrame) -> DataFrame:
    """Entries per locale by origin and freshness.

    A blank entry counts as present here, unlike in the plan.  Locales without a catalog
    appear with every key missing.
    """
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    s = source.select("project", "key", F.col("source_hash").alias("_expected"))
    matched = F.col("_expected").isNotNull()
    counted = entries.join(shuffled(s), ["project", "key"], "left").groupBy("project", "locale").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(matched & F.col("reviewed")).alias("reviewed"),
        F.count_if(matched & ~F.col("reviewed")).alias("machine_translated"),
        F.count_if(matched & (F.col("source_hash") != F.col("_expected"))).alias("stale"),
        F.count_if(~matched).alias("orphaned"))
    keys = source.groupBy("project").agg(F.count(F.lit(1)).alias("_keys"))
    numbers = ["total_entries", "reviewed", "machine_translated", "stale", "orphaned"]
    return targets.join(counted, ["project", "locale"], "left").join(keys, "project").select(
        "project", "locale", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        (F.col("_keys") - F.coalesce("reviewed", F.lit(0)) - F.coalesce("machine_translated", F.lit(0))
         ).alias("missing"))


def platform_inventory(platform_entries: DataFrame, locales: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Source-locale keys and the sorted locales seen, per project and platform.

    ``versions`` (project, platform, version) adds the format version of the documents, null where a format has none.
    """
    sources = locales.filter("is_source").select("project", F.col("locale").alias("_source"))
    seen = platform_entries.select("project", "platform", "locale", "key").join(sources, "project", "left")
    # First to one row per locale, map-side, so the gathered set is as short as the locale list.
    per_locale = seen.groupBy("project", "platform", "locale").agg(
        F.count_distinct(F.when(F.col("locale") == F.col("_source"), F.col("key"))).alias("_keys"))
    found = per_locale.groupBy("project", "platform").agg(
        F.sum("_keys").alias("key_count"), F.array_sort(F.collect_set("locale")).alias("locales"))
    if versions is None:
        return found
    return found.join(versions.select("project", "platform", "version"), ["project", "platform"], "left")


def import_report(source: DataFrame, imported: DataFrame, locales: DataFrame) -> DataFrame:
    """Imported and missing keys per target locale."""
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    keys = source.groupBy("project").agg(F.count(F.lit(1)).alias("_keys"))
    got = imported.groupBy("project", "locale").agg(F.count(F.lit(1)).alias("imported"))
    return targets.join(keys, "project").join(got, ["project", "locale"], "left").select(
        "project", "locale", F.coalesce("imported", F.lit(0)).alias("imported"),
        (F.col("_keys") - F.coalesce("imported", F.lit(0))).alias("missing"))
