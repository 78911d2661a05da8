"""Turning responses and cache hits into entries, and platform resources into a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, shape, union_diagnostics
from lexilake.functions.hashing import source_hash
from lexilake.functions.text import has_parity, is_blank
from lexilake.schemas import CACHE_KEY, ENTRY_COLUMNS
from lexilake.session import durable, release, shuffled


# A provider's answer is that of one task; a recorded one is that of a text.
TASK_KEY = ["project", "locale", "key"]
TEXT_KEY = ["source_locale", "locale", "source_text"]


def first_responses(responses: DataFrame) -> DataFrame:
    """One response per task, or per text where the responses name no task: the one recorded first."""
    key = TASK_KEY if set(TASK_KEY) <= set(responses.columns) else TEXT_KEY
    return responses.groupBy(*key).agg(F.min(F.struct(
        "response_no", "text", "model_version", "error_code")).alias("_r")).select(
        *key, F.col("_r.text").alias("response_text"), F.col("_r.model_version").alias("response_model"),
        F.col("_r.error_code").alias("error_code"))


def task_outcomes(tasks: DataFrame, responses: DataFrame, source: DataFrame,
                  source_locale: str = "en") -> DataFrame:
    """Each task with its result: cached, translated, mismatch, failed or unanswered.

    Cached text is taken as it is, with its parity in a column of its own.
    """
    s = source.select("project", "key", F.col("text").alias("source_text"))
    first = first_responses(responses)
    answered = (
        tasks.join(shuffled(s), ["project", "key"])
        .withColumn("source_locale", F.lit(source_locale))
        .join(shuffled(first), [k for k in first.columns if k in TASK_KEY + TEXT_KEY], "left"))
    cached = F.col("cache_text").isNotNull()
    text = F.when(cached, F.col("cache_text")).otherwise(F.col("response_text"))
    judged = answered.withColumn("text", text).withColumn(
        "parity", has_parity(F.col("source_text"), F.col("text")))
    outcome = (
        F.when(cached, "cached")
        .when(F.col("error_code").isNotNull(), "failed")
        .when(F.col("response_text").isNull(), "unanswered")
        .when(F.col("parity"), "translated")
        .otherwise("mismatch"))
    return judged.withColumn("outcome", outcome)


def apply_responses(tasks: DataFrame, responses: DataFrame, source: DataFrame, configs: DataFrame,
                    provider_id: str, now: Column, strict: bool = False,
                    source_locale: str = "en") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entries, new cache rows and findings of one run.

    A mismatch is skipped and reported.  With ``strict`` a project with any mismatch gets no
    rows at all: a distributed run has no "first" failure to stop at.
    """
    # Three outputs read the outcomes, so they are stored once.
    done = durable(task_outcomes(tasks, responses, source, source_locale))
    # What reads them does not need the shuffles of the plan that made them.
    release(done.sparkSession)
    usable = done.filter(F.col("outcome").isin("cached", "translated"))
    if strict:
        blocked = done.filter(F.col("outcome") == "mismatch").select("project").distinct()
        usable = usable.join(blocked, "project", "left_anti")
    from_cache = F.col("outcome") == "cached"
    entries = usable.select(
        "project", "locale", "key", "text", F.lit(False).alias("reviewed"), F.lit(False).alias("stale"),
        "source_hash", F.lit(provider_id).alias("provider"),
        F.when(from_cache, F.col("cache_model")).otherwise(F.col("response_model")).alias("model_version"),
        F.when(from_cache, F.col("cached_at")).otherwise(now).alias("translated_at"))
    fresh = usable.filter(~from_cache).join(configs.select("project", "config_hash"), "project")
    # Keys with the same content share a cache row, as repeated upserts would leave one.
    cache_rows = fresh.groupBy("project", "source_hash", "locale", "config_hash",
                               F.col("response_model").alias("model_version")).agg(
        F.max("text").alias("text")).withColumn("cached_at", now)
    findings = union_diagnostics(
        diagnose(done.filter(F.col("outcome") == "mismatch"), "L10N_E0041",
                 {"source": F.col("source_text"), "target": F.col("text")}),
        diagnose(done.filter(F.col("outcome") == "unanswered"), "L10N_E0081"),
        shape(done.filter(F.col("outcome") == "failed").select(
            "project", F.col("error_code").alias("code"), F.lit("error").alias("level"), "locale", "key")))
    return entries, cache_rows.select(*CACHE_KEY, "text", "cached_at"), findings


def upsert_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace those of the same project, locale and key."""
    at = ["project", "locale", "key"]
    return entries.join(shuffled(new.select(*at)), at, "left_anti").unionByName(new.select(*ENTRY_COLUMNS))


def source_from_platform(platform_entries: DataFrame, locales: DataFrame) -> DataFrame:
    """Source keys as the source-locale rows of a platform declare them."""
    sources = locales.filter("is_source").select("project", "locale")
    declared = F.map_from_entries(F.transform("placeholders", lambda p: F.struct(
        p["name"], F.struct(F.lit(None).cast("string").alias("example"), p["type"].alias("type")))))
    rows = platform_entries.join(sources, ["project", "locale"]).filter(F.length("text") > 0).select(
        "project", "locale", "key", "text", F.nullif("comment", F.lit("")).alias("description"),
        declared.alias("placeholders"))
    return rows.withColumn("source_hash", source_hash(
        F.col("text"), F.col("description"), F.col("placeholders")))


def import_catalog(platform_entries: DataFrame, locales: DataFrame, from_: str,
                   now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source, reviewed entries and findings taken from native resources.

    Blank translations are left out; those with other placeholders are left out and reported.
    """
    source = source_from_platform(platform_entries, locales)
    targets = locales.filter(~F.col("is_source")).select("project", "locale")
    native = platform_entries.join(targets, ["project", "locale"], "left_semi").filter(
        ~is_blank(F.col("text"))).select("project", "locale", "key", "text")
    pairs = native.join(shuffled(source.select(
        "project", "key", F.col("text").alias("source_text"), "source_hash")), ["project", "key"])
    parity = has_parity(F.col("source_text"), F.col("text"))
    entries = pairs.filter(parity).select(
        "project", "locale", "key", "text", F.lit(True).alias("reviewed"), F.lit(False).alias("stale"),
        "source_hash", F.lit(f"import:{from_}").alias("provider"), F.lit("import").alias("model_version"),
        now.alias("translated_at"))
    empty = locales.select("project").distinct().join(source.select("project"), "project", "left_anti")
    findings = union_diagnostics(
        diagnose(pairs.filter(~parity), "L10N_E0041"),
        diagnose(empty, "L10N_E0010", {"from": F.lit(from_)}))
    return source, entries, findings


def sync_report(plan_totals: DataFrame, entries: DataFrame) -> DataFrame:
    """Run totals per project and the sentence the history log keeps."""
    totals = plan_totals.filter(F.col("locale").isNull())
    made = entries.groupBy("project").agg(F.count(F.lit(1)).alias("_made"))
    # Every cache hit becomes an entry, so the rest of the new entries were translated.
    translated = F.greatest(F.coalesce("_made", F.lit(0)) - F.col("cache_hits"), F.lit(0))
    return totals.join(made, "project", "left").select(
        "project", translated.alias("translated"), "cache_hits",
        (F.col("pending") - F.col("cache_hits")).alias("provider_requests"),
        F.col("reviewed_stale").alias("reviewed_skipped"), "removed",
        F.format_string(
            "%d translations generated, %d cache hits, %d reviewed skipped, %d removed",
            translated, F.col("cache_hits"), F.col("reviewed_stale"), F.col("removed")).alias("summary"))
