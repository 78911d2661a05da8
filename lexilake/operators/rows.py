"""Selection, validation and freshness of single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose
from lexilake.functions.locales import valid_locale
from lexilake.functions.text import is_blank
from lexilake.session import shuffled

HASH = r"\Asha256:[0-9a-f]{64}\z"
INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z\z"


def latest_entry(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest version per key; ``order`` names the columns compared, all descending.

    A max over a struct combines map-side, so a key with many versions never gathers them.
    """
    rest = [c for c in versions.columns if c not in keys and c not in order]
    newest = versions.groupBy(*keys).agg(F.max_by(
        F.struct(*order, *rest), F.struct(*order)).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in versions.columns if c not in keys])


def select_locales(locales: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Target locales to work on, and a finding for each requested name that is not configured."""
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    if not names:
        return targets, diagnose(targets.limit(0), "L10N_E0069")
    wanted = sorted(set(names))
    chosen = targets.filter(F.col("locale").isin(wanted))
    asked = targets.select("project").distinct().select(
        "project", F.explode(F.array(*[F.lit(n) for n in wanted])).alias("locale"))
    unknown = asked.join(targets, ["project", "locale"], "left_anti")
    return chosen, diagnose(unknown, "L10N_E0069")


def is_missing(text: Column) -> Column:
    """No entry, or an entry of white space."""
    return is_blank(text)


def is_stale(entry_hash: Column, source_hash: Column) -> Column:
    return entry_hash != source_hash


def live_entries(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Entries whose key is still in the source."""
    return entries.join(shuffled(source.select("project", "key")), ["project", "key"], "left_semi")


def removed_entries(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Entries whose key left the source."""
    return entries.join(shuffled(source.select("project", "key")), ["project", "key"], "left_anti")


def dirty_locales(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Catalogs that lose entries to :func:`live_entries`, and so must be rewritten."""
    return removed_entries(entries, source).select("project", "locale").distinct()


def refresh_stale_flags(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Set the flag on reviewed entries that fell behind, clear it on entries that caught up."""
    s = source.select("project", "key", F.col("source_hash").alias("_expected"))
    behind = F.col("reviewed") & (F.col("source_hash") != F.col("_expected")) & ~F.col("stale")
    caught_up = (F.col("source_hash") == F.col("_expected")) & F.col("stale")
    changed = F.coalesce(behind | caught_up, F.lit(False))
    return (
        entries.join(shuffled(s), ["project", "key"], "left")
        .withColumn("changed", changed)
        .withColumn("stale", F.when(F.col("changed"), ~F.col("stale")).otherwise(F.col("stale")))
        .drop("_expected"))


def validate_rows(df: DataFrame, checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that pass every check and those with the failed checks' names."""
    checks = checks or {
        "locale": valid_locale(F.col("locale")),
        "source_hash": F.col("source_hash").rlike(HASH),
        "translated_at": F.col("translated_at").rlike(INSTANT),
        "text": F.col("text").isNotNull(),
    }
    failed = F.filter(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
    ]), lambda f: f.isNotNull())
    judged = df.withColumn("failed", failed)
    return judged.filter(F.size("failed") == 0).drop("failed"), judged.filter(F.size("failed") > 0)


def escapes_root(path: Column) -> Column:
    """A relative path leaves its root: absolute, or ``..`` climbs above it at some step.

    Only the final position counts, as path resolution does: ``a/../../root/x`` cannot be
    told apart from an escape without the root's own name, so it counts as one.
    """
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda acc, part: F.struct(
            F.when(part == "..", acc["d"] - 1).when(part.isin("", "."), acc["d"])
            .otherwise(acc["d"] + 1).alias("d"),
            (acc["out"] | ((part == "..") & (acc["d"] <= 0))).alias("out")),
        lambda acc: acc["out"])
    return path.startswith("/") | depth


def snapshot_path_guard(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows that stay under the root, and those that do not."""
    bad = escapes_root(F.col("path"))
    return snapshots.filter(~bad), snapshots.filter(bad)


def locale_delta(files: DataFrame, locales: DataFrame) -> DataFrame:
    """Locales configured without a catalog (added) and catalogs no longer configured (removed).

    The delta is taken against the configured locales, never against a selection of them.
    """
    have = files.filter(valid_locale(F.col("locale"))).select("project", "locale").distinct()
    want = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    source = locales.filter("is_source").select("project", "locale")
    added = want.join(have, ["project", "locale"], "left_anti").withColumn("change", F.lit("added"))
    removed = have.join(want.unionByName(source), ["project", "locale"], "left_anti").withColumn(
        "change", F.lit("removed"))
    return added.unionByName(removed)


def history_stats(history: DataFrame) -> DataFrame:
    """Rows per project and the time of the last row in log order, which need not be the latest."""
    return history.groupBy("project").agg(
        F.count(F.lit(1)).alias("entries"), F.max_by("ts", "line_no").alias("last_at"))


def resume_state_filter(state: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved progress whose fingerprints still hold, and a warning for the rest.

    Legacy rows carry no fingerprints and never match.
    """
    keys = ["project", "config_hash", "source_hash"]
    kept = state.join(fingerprints.select(*keys), keys, "left_semi")
    dropped = state.join(fingerprints.select(*keys), keys, "left_anti")
    return kept, diagnose(dropped, "L10N_E0080")
