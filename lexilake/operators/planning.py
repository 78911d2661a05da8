"""What a translation run has to do: tasks, cache hits, counts and request rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.functions.hashing import percent_complete
from lexilake.functions.text import canonical_placeholders, is_blank
from lexilake.session import shuffled

HIT = ["cache_text", "cache_model", "cached_at"]


def target_grid(source: DataFrame, locales: DataFrame) -> DataFrame:
    """Every source key in every target locale of its project."""
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    return source.drop("locale").join(targets, "project")


def classify_pairs(source: DataFrame, entries: DataFrame, locales: DataFrame) -> DataFrame:
    """Grid of keys and locales with the state of each: missing, stale, reviewed_stale, current.

    A key's entries, at most one for each target locale, meet the key once, and its locales are told apart in its row:
    neither the grid nor any text is shuffled.
    """
    targets = locales.filter(~F.col("is_source")).select("project", "locale").distinct()
    listed = targets.groupBy("project").agg(F.collect_list("locale").alias("_targets"))
    have = entries.join(targets, ["project", "locale"], "left_semi").select("project", "key", F.struct(
        "locale", "reviewed", is_blank(F.col("text")).alias("blank"), F.col("source_hash").alias("hash")).alias("_e"))
    gathered = have.groupBy("project", "key").agg(F.collect_list("_e").alias("_have"))
    keys = source.select("project", "key", "source_hash").join(listed, "project").join(shuffled(gathered), ["project", "key"], "left")
    grid = keys.select("project", "key", "source_hash", "_have", F.explode("_targets").alias("locale")).select(
        "project", "locale", "key", "source_hash", F.explode_outer(F.filter("_have", lambda e: e["locale"] == F.col("locale"))).alias("_e"))
    state = (
        F.when(F.coalesce("_e.blank", F.lit(True)), F.lit("missing"))
        .when(F.col("_e.hash") == F.col("source_hash"), F.lit("current"))
        .when(F.col("_e.reviewed"), F.lit("reviewed_stale"))
        .otherwise(F.lit("stale")))
    return grid.select("project", "locale", "key", "source_hash", state.alias("reason"))


def newest_cache(cache: DataFrame, configs: DataFrame) -> DataFrame:
    """Newest cached text per source hash and locale under the project's configuration, any model.

    Ties in time fall to the higher model version, then the higher text: a table has no file order.
    """
    current = cache.join(configs.select("project", "config_hash"), ["project", "config_hash"], "left_semi")
    return current.groupBy("project", "source_hash", "locale").agg(
        F.max(F.struct("cached_at", "model_version", "text")).alias("_hit")
    ).select("project", "source_hash", "locale", F.col("_hit.text").alias("cache_text"),
             F.col("_hit.model_version").alias("cache_model"), F.col("_hit.cached_at").alias("cached_at"))


def cache_lookup(tasks: DataFrame, cache: DataFrame, configs: DataFrame) -> DataFrame:
    """Add the newest matching cache row to each task: reduce first, then one equi-join."""
    return tasks.join(shuffled(newest_cache(cache, configs)), ["project", "source_hash", "locale"], "left")


def plan_sync(source: DataFrame, entries: DataFrame, locales: DataFrame, cache: DataFrame,
              configs: DataFrame) -> DataFrame:
    """Pending tasks: pairs that are missing, or stale and not reviewed, with their cache hit."""
    pending = classify_pairs(source, entries, locales).filter(F.col("reason").isin("missing", "stale"))
    return cache_lookup(pending, cache, configs).select(
        "project", "locale", "key", "reason", "source_hash", *HIT)


def uncached_requests(tasks: DataFrame) -> DataFrame:
    """Tasks that need the provider."""
    return tasks.filter(F.col("cache_text").isNull())


def estimate_requests(tasks: DataFrame) -> DataFrame:
    """One provider request per uncached task."""
    return uncached_requests(tasks).groupBy("project").agg(F.count(F.lit(1)).alias("requests"))


def plan_summary(source: DataFrame, entries: DataFrame, locales: DataFrame, cache: DataFrame,
                 configs: DataFrame) -> DataFrame:
    """Counts per project and locale with a total row per project (locale NULL).

    The cache is matched only to the pairs that are pending, and joined after the pair counts
    are split off, so one pass over the grid feeds every column.
    """
    pairs = classify_pairs(source, entries, locales)
    hits = newest_cache(cache, configs).select("project", "source_hash", "locale", F.lit(True).alias("_hit"))
    pending = F.col("reason").isin("missing", "stale")
    counted = pairs.join(shuffled(hits), ["project", "source_hash", "locale"], "left").groupBy("project", "locale").agg(
        F.count_if(F.col("reason") == "missing").alias("missing"),
        F.count_if(F.col("reason") == "stale").alias("stale_retranslations"),
        F.count_if(F.col("reason") == "reviewed_stale").alias("reviewed_stale"),
        F.count_if(pending & F.col("_hit")).alias("cache_hits"),
        F.count_if(pending).alias("pending"))
    targets = locales.filter(~F.col("is_source")).select("project", "locale")
    gone = (
        entries.select("project", "locale", "key")
        .join(targets, ["project", "locale"], "left_semi")
        .join(shuffled(source.select("project", "key")), ["project", "key"], "left_anti")
        .groupBy("project", "locale").agg(F.count(F.lit(1)).alias("removed")))
    per_locale = counted.join(gone, ["project", "locale"], "left").withColumn(
        "removed", F.coalesce("removed", F.lit(0)))
    numbers = ["missing", "stale_retranslations", "reviewed_stale", "removed", "cache_hits", "pending"]
    return per_locale.rollup("project", "locale").agg(
        *[F.sum(n).alias(n) for n in numbers]).filter(F.col("project").isNotNull())


def platform_writes(source: DataFrame, locales: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows each configured platform receives: keys times target locales plus the source."""
    keys = source.groupBy("project").agg(F.count(F.lit(1)).alias("_keys"))
    targets = locales.filter(~F.col("is_source")).groupBy("project").agg(
        F.count_distinct("locale").alias("_locales"))
    return platforms.select("project", "platform").join(keys, "project").join(targets, "project").select(
        "project", "platform", (F.col("_keys") * (F.col("_locales") + 1)).alias("platform_writes"))


def status_summary(plan_totals: DataFrame, state: DataFrame) -> DataFrame:
    """Plan totals per project beside the progress of its saved run, if any."""
    totals = plan_totals.filter(F.col("locale").isNull()).drop("locale")
    done, planned = F.col("completed_translations"), F.col("total_translations")
    progress = state.select(
        "project", "completed_translations", "total_translations", "status",
        percent_complete(done, planned).alias("percent_complete"),
        F.greatest(F.lit(0), planned - done).alias("remaining"))
    return totals.join(shuffled(progress), "project", "left").withColumn(
        "sync_state", F.coalesce("status", F.lit("idle"))).drop("status").withColumn(
        "provider_requests", F.col("pending") - F.col("cache_hits"))


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """Usable glossary rows: a blank target preserves nothing."""
    return glossary.filter(F.coalesce(F.length("target_term"), F.lit(0)) > 0)


def translation_requests(tasks: DataFrame, source: DataFrame, glossary: DataFrame,
                         source_locale: str = "en") -> DataFrame:
    """What the provider is asked per task; the glossary is that of the target locale.

    A project's glossary is configuration that its request texts embed whole, so its terms for
    one locale are gathered once per (project, locale), never per task.
    """
    terms = glossary_lines(glossary).groupBy("project", "locale").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_term").alias("source"),
                                             F.col("target_term").alias("target")))).alias("glossary"))
    s = source.select("project", "key", "text", "description",
                      canonical_placeholders(F.col("text"), F.col("placeholders")).alias("placeholders"))
    empty = F.array().cast("array<struct<source:string,target:string>>")
    return tasks.join(shuffled(s), ["project", "key"]).join(terms, ["project", "locale"], "left").select(
        "project", "locale", "key", F.lit(source_locale).alias("source_locale"),
        F.col("text").alias("source_text"), "description", "placeholders",
        F.coalesce("glossary", empty).alias("glossary"), "source_hash")


_PROMPT_HEAD = "You translate short texts of an app's screens."
_PROMPT_RULES = [
    'Answer with one JSON object whose "text" member is the translation.',
    "Keep every placeholder letter for letter and as often as it occurs.",
    "Write no notes of your own and make up no placeholders.",
]


def prompt_text(requests: DataFrame) -> DataFrame:
    """Add ``prompt``: the request row as text."""
    names = F.array_join(F.transform("placeholders", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ", ")
    terms = F.array_join(F.transform(
        "glossary", lambda g: F.concat(F.lit("- "), g["source"], F.lit(" => "), g["target"])), "\n")
    described = F.coalesce(F.length("description"), F.lit(0)) > 0
    return requests.withColumn("prompt", F.concat_ws(
        "\n\n",
        F.lit(_PROMPT_HEAD),
        F.concat(F.lit("From: "), F.col("source_locale")),
        F.concat(F.lit("Into: "), F.col("locale")),
        *[F.lit(rule) for rule in _PROMPT_RULES],
        F.concat(F.lit("Placeholders: "), F.when(F.size("placeholders") > 0, names).otherwise("none")),
        F.when(described, F.concat(F.lit("Used for: "), F.col("description"))),
        F.when(F.size("glossary") > 0, F.concat(F.lit("Terms:\n"), terms)),
        F.concat(F.lit("Text:\n"), F.col("source_text"))))
