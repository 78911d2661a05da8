"""Planning and applying a translation run, importing native resources, restoring snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, has_errors, shape, union_diagnostics
from lexilake.operators.applying import apply_responses, import_catalog, upsert_entries
from lexilake.operators.audit import archived_warnings, configured, orphaned_reviewed, sync_gate
from lexilake.operators.cache import gc_cache, upsert_cache
from lexilake.operators.coverage import import_report
from lexilake.operators.linting import lint_keys
from lexilake.operators.planning import plan_summary, plan_sync
from lexilake.operators.restoring import restore_as_of
from lexilake.operators.rows import live_entries, refresh_stale_flags, removed_entries, snapshot_path_guard
from lexilake.plans.catalog import Catalog
from lexilake.providers import PLATFORM_FORMATS
from lexilake.session import durable, release
from lexilake.sinks.archive import name_archives


def plan_run(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """The tasks of a run and their counts per locale."""
    tables = (c.source, c.entries, c.locales, c.cache, c.configs)
    return plan_sync(*tables), plan_summary(*tables)


@dataclass(frozen=True)
class SyncResult:
    """What a run leaves behind.

    ``archive`` has the entries that left the catalog but must not be lost, each with its reason and the
    name of its archive; ``removed`` the machine-made ones without a key, which go.  Every entry given is in
    ``entries``, replaced there, in ``archive`` or in ``removed``.
    """

    entries: DataFrame
    cache: DataFrame
    archive: DataFrame
    removed: DataFrame
    history: DataFrame
    diagnostics: DataFrame


def apply_sync(c: Catalog, responses: DataFrame, provider_id: str, now: Column,
               strict: bool = False, taken: DataFrame | None = None) -> SyncResult:
    """Next entries and cache of every project that its checks let through.

    A project with an error among its key or entry findings is left as it is: all its entries, of whatever
    locale, and its cache.  Entries of a locale a project no longer targets go to the archive, and so do
    reviewed entries that lost their key; ``taken`` has the names and attempts of archives written before.
    """
    targeted = configured(c.entries, c.locales)
    before = union_diagnostics(lint_keys(c.source, c.rules), sync_gate(targeted, c.source))
    if c.reader_findings is not None:
        before = before.unionByName(shape(c.reader_findings))
    # One row per blocked project; the gate is settled before anything is planned.
    blocked = durable(has_errors(before).filter("not ok").select("project"))
    release(blocked.sparkSession)

    def passed(df: DataFrame) -> DataFrame:
        return df.join(blocked, "project", "left_anti")

    def held(df: DataFrame) -> DataFrame:
        return df.join(blocked, "project", "left_semi")

    source, open_entries = passed(c.source), passed(targeted)
    tasks = plan_sync(source, open_entries, c.locales, c.cache, c.configs)
    new, new_cache, found = apply_responses(
        tasks, responses, source, c.configs, provider_id, now, strict, c.source_locale)
    kept = refresh_stale_flags(live_entries(open_entries, source), source).drop("changed")
    targets = c.locales.filter(~F.col("is_source")).select("project", "locale")
    gone = passed(c.entries).join(targets, ["project", "locale"], "left_anti").withColumn("reason", F.lit("locale"))
    orphans = orphaned_reviewed(open_entries, source).withColumn("reason", F.lit("key"))
    if taken is None:
        taken = c.locales.select(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("attempt")).limit(0)
    archive = durable(name_archives(gone.unionByName(orphans.select(*gone.columns)), now, taken).drop("name", "attempt"))
    release(archive.sparkSession)
    history = archive.groupBy("project", "locale", "archive_name").agg(
        F.max(F.col("reason") == "locale").alias("_gone"), F.count(F.lit(1)).alias("entries")).select(
        "project", F.when(F.col("_gone"), "remove_locale").otherwise("archive_entries").alias("op"),
        "locale", "archive_name", "entries", now.alias("ts"))
    return SyncResult(
        entries=upsert_entries(kept, new).unionByName(held(c.entries).select(*kept.columns)),
        cache=gc_cache(upsert_cache(passed(c.cache), new_cache), c.source).unionByName(held(c.cache)),
        archive=archive,
        removed=removed_entries(open_entries, source).filter(~F.col("reviewed")),
        history=history,
        diagnostics=union_diagnostics(before, found, archived_warnings(archive.filter("reason = 'key'"))))


@dataclass(frozen=True)
class ImportResult:
    """What an import gives: source keys, reviewed entries, findings of reader and import, counts per locale."""

    source: DataFrame
    entries: DataFrame
    diagnostics: DataFrame
    report: DataFrame


def import_files(spark: SparkSession, path: str, kind: str, locales: DataFrame, now: Column, **options) -> ImportResult:
    """Take over the native resources below ``path``, of one of the registered formats, as catalogs.

    ``options`` go to the reader of the format.
    """
    read, bad = PLATFORM_FORMATS[kind].ingest(spark, path, **options)
    rows = durable(read)
    source, entries, found = import_catalog(rows, locales, kind, now)
    return ImportResult(source, entries, union_diagnostics(shape(bad), found), import_report(source, entries, locales))


def restore(snapshots: DataFrame, current: DataFrame, history: DataFrame,
            history_id: str) -> tuple[DataFrame, DataFrame]:
    """Restore actions of one history id; a project with an unsafe path takes no part."""
    _, unsafe = snapshot_path_guard(snapshots)
    bad = unsafe.filter(unsafe["history_id"] == history_id)
    safe = snapshots.join(bad.select("project").distinct(), "project", "left_anti")
    plan, unknown = restore_as_of(safe, current, history, history_id)
    return plan, union_diagnostics(unknown, diagnose(bad, "L10N_E0062"))
