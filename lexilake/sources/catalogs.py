"""Source catalogs, translation catalogs, the cache and saved run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, union_diagnostics
from lexilake.functions.hashing import source_hash
from lexilake.functions.locales import valid_locale
from lexilake.operators.rows import HASH, INSTANT, resume_state_filter
from lexilake.schemas import PLACEHOLDERS
from lexilake.session import durable
from lexilake.sources.documents import (
    all_values, is_absent, is_integer, is_object, is_string, json_type, judged_once, members, once, parse_once, read_documents,
)
from lexilake.sources.members import DOCUMENT, keyed, of_documents, read_members

PLACEHOLDER_TYPES = ["string", "number", "date"]
SOURCE_ITEM = "struct<text:string,description:string,placeholders:" + PLACEHOLDERS + ">"
ENTRY_ITEM = ("struct<text:string,reviewed:boolean,stale:boolean,source_hash:string,provider:string,"
              "model_version:string,translated_at:string>")
CACHE_ITEM = "struct<source_hash:string,locale:string,config_hash:string,model_version:string,text:string,cached_at:string>"


def _version(v, number):
    return is_integer(v, "$.version") & (F.try_variant_get(v, "$.version", "double") == number)


def judge(docs: DataFrame, items: DataFrame, condition) -> DataFrame:
    """Documents (see ``of_documents``) with ``good``: well-formed, as ``condition`` asks, and every item fine."""
    faulty = items.filter(~F.coalesce("item.ok", F.lit(False))).select(*DOCUMENT, F.lit(True).alias("_faulty")).distinct()
    return durable(docs.join(faulty, DOCUMENT, "left").withColumn(
        "good", F.col("good") & F.coalesce(condition, F.lit(False)) & F.col("_faulty").isNull()).drop("_faulty"))


def _string_or_absent(v, path):
    return is_absent(v, path) | is_string(v, path)


def _boolean_or_absent(v, path):
    return is_absent(v, path) | F.coalesce(json_type(v, path) == "BOOLEAN", F.lit(False))


def _instant(v, path):
    return is_string(v, path) & F.try_variant_get(v, path, "string").rlike(INSTANT)


def _good_placeholder(p):
    kind = F.try_variant_get(p, "$.type", "string")
    return is_string(p, "$.type") & kind.isin(PLACEHOLDER_TYPES) & _string_or_absent(p, "$.example")


def _good_source_key(k):
    return (
        is_object(k) & is_string(k, "$.text") & (F.length(F.try_variant_get(k, "$.text", "string")) > 0)
        & _string_or_absent(k, "$.description")
        & (is_absent(k, "$.placeholders")
           | (is_object(k, "$.placeholders") & all_values(members(k, "$.placeholders"), _good_placeholder))))


def parse_source_catalogs(docs: DataFrame, source_locale: str = "en") -> tuple[DataFrame, DataFrame]:
    """Rows of every well-formed source catalog, each with its content hash."""
    v = F.col("v")
    version = is_integer(v, "$.version") & (F.try_variant_get(v, "$.version", "double") == 1)
    good = F.coalesce(version & is_object(v, "$.keys") & all_values(members(v, "$.keys"), _good_source_key),
                      F.lit(False))
    judged = judged_once(once(parse_once(docs, "v", F.col("text")), "good", good), _keys=F.when(
        F.col("good"), F.try_variant_get(v, "$.keys", f"map<string,{SOURCE_ITEM}>")))
    rows = judged.filter("good").select("project", F.explode("_keys").alias("key", "_k"))
    return _source_rows(rows, source_locale), diagnose(judged.filter(~F.col("good")), "L10N_E0010")


def _source_rows(rows: DataFrame, source_locale: str) -> DataFrame:
    none = F.create_map().cast(PLACEHOLDERS)
    flat = rows.select(
        "project", F.lit(source_locale).alias("locale"), "key", F.col("_k.text").alias("text"),
        F.col("_k.description").alias("description"),
        F.coalesce("_k.placeholders", none).alias("placeholders"))
    return flat.withColumn("source_hash", source_hash(F.col("text"), F.col("description"), F.col("placeholders")))


def source_members(rows: DataFrame, source_locale: str = "en") -> tuple[DataFrame, DataFrame]:
    """As ``parse_source_catalogs``, of documents given as their members."""
    v, item = F.col("v"), F.col("_v")
    docs = durable(of_documents(rows, version=_version(v, 1), keys=is_object(v, "$.keys")))
    items = durable(keyed(rows, docs, "keys", F.struct(
        _good_source_key(item).alias("ok"), F.try_variant_get(item, "$", SOURCE_ITEM).alias("_k"))))
    judged = judge(docs, items, F.col("version") & F.col("keys"))
    fine = items.join(judged.filter("good").select(*DOCUMENT), DOCUMENT).select("project", "key", "item._k")
    return _source_rows(fine, source_locale), diagnose(judged.filter(~F.col("good")), "L10N_E0010")


def read_source_catalogs(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Source catalogs of any size below ``path``, written by ``write_sources`` or as files of one document each."""
    return source_members(read_members(spark, path, ids=["project", "locale"], **options))


def _good_entry(e):
    return (
        is_object(e) & is_string(e, "$.text") & is_string(e, "$.model_version") & is_string(e, "$.provider")
        & is_string(e, "$.source_hash") & F.try_variant_get(e, "$.source_hash", "string").rlike(HASH)
        & _instant(e, "$.translated_at") & _boolean_or_absent(e, "$.reviewed") & _boolean_or_absent(e, "$.stale"))


def parse_translations(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of every well-formed translation catalog; the document names its own locale."""
    v = F.col("v")
    version = is_integer(v, "$.version") & (F.try_variant_get(v, "$.version", "double") == 1)
    locale = is_string(v, "$.locale") & valid_locale(F.try_variant_get(v, "$.locale", "string"))
    good = F.coalesce(version & locale & is_object(v, "$.entries")
                      & all_values(members(v, "$.entries"), _good_entry), F.lit(False))
    judged = judged_once(
        once(parse_once(docs, "v", F.col("text")), "good", good), _locale=F.try_variant_get(v, "$.locale", "string"),
        _entries=F.when(F.col("good"), F.try_variant_get(v, "$.entries", f"map<string,{ENTRY_ITEM}>")))
    rows = judged.filter("good").select("project", F.col("_locale").alias("locale"), F.explode("_entries").alias("key", "e"))
    return _entry_rows(rows), diagnose(judged.filter(~F.col("good")), "L10N_E0011")


def _entry_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project", "locale", "key", "e.text",
        F.coalesce("e.reviewed", F.lit(False)).alias("reviewed"), F.coalesce("e.stale", F.lit(False)).alias("stale"),
        "e.source_hash", "e.provider", "e.model_version",
        F.to_timestamp_ntz(F.regexp_replace("e.translated_at", "Z$", "")).alias("translated_at"),
        F.col("e.translated_at").alias("translated_at_text"))


def translation_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_translations``, of documents given as their members."""
    v, item = F.col("v"), F.col("_v")
    name = F.try_variant_get(v, "$.locale", "string")
    docs = durable(of_documents(rows, version=_version(v, 1), entries=is_object(v, "$.entries"), locale=F.when(
        is_string(v, "$.locale") & valid_locale(name), name)))
    items = durable(keyed(rows, docs, "entries", F.struct(
        _good_entry(item).alias("ok"), F.try_variant_get(item, "$", ENTRY_ITEM).alias("e"))))
    judged = judge(docs, items, F.col("version") & F.col("entries") & F.col("locale").isNotNull())
    fine = items.join(judged.filter("good").select(*DOCUMENT, "locale"), DOCUMENT).select("project", "locale", "key", "item.e")
    return _entry_rows(fine), diagnose(judged.filter(~F.col("good")).drop("locale"), "L10N_E0011")


def read_translations(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Translation catalogs of any size below ``path``, written by ``write_catalogs`` or as files of one document each."""
    return translation_members(read_members(spark, path, ids=["project", "locale"], **options))


def _good_cache_row(c):
    return (
        is_object(c) & _instant(c, "$.cached_at") & is_string(c, "$.text") & is_string(c, "$.model_version")
        & F.try_variant_get(c, "$.config_hash", "string").rlike(HASH)
        & F.try_variant_get(c, "$.source_hash", "string").rlike(HASH)
        & valid_locale(F.try_variant_get(c, "$.locale", "string")))


def parse_cache(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of current caches.  Older versions count as empty with a warning, others as broken."""
    v = F.col("v")
    version = F.when(is_integer(v, "$.version"), F.try_variant_get(v, "$.version", "double"))
    rows = F.try_variant_get(v, "$.entries", "array<variant>")
    current = F.coalesce((version == 3) & F.forall(rows, _good_cache_row), F.lit(False))
    state = F.when(current, "current").when(version.isin(1, 2), "legacy").otherwise("broken")
    judged = judged_once(once(parse_once(docs, "v", F.col("text")), "state", state), _rows=F.when(
        F.col("state") == "current", F.try_variant_get(v, "$.entries", f"array<{CACHE_ITEM}>")))
    flat = judged.filter("state = 'current'").select("project", F.explode("_rows").alias("c"))
    return _cache_rows(flat), _cache_findings(judged)


def _cache_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project", "c.source_hash", "c.locale", "c.config_hash", "c.model_version", "c.text",
        F.to_timestamp_ntz(F.regexp_replace("c.cached_at", "Z$", "")).alias("cached_at"))


def _cache_findings(docs: DataFrame) -> DataFrame:
    return union_diagnostics(
        diagnose(docs.filter("state = 'legacy'"), "L10N_E0086"),
        diagnose(docs.filter("state = 'broken'"), "L10N_E0060"))


def cache_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_cache``, of documents given as their members."""
    v, item = F.col("v"), F.col("_v")
    is_list = F.coalesce(json_type(v, "$.entries").startswith("ARRAY"), F.lit(False))
    docs = durable(of_documents(rows, version=F.when(is_integer(v, "$.version"), F.try_variant_get(v, "$.version", "double")), entries=is_list))
    last = docs.select(*DOCUMENT, F.col("entries_member").alias("member"))
    items = durable(rows.filter(~is_absent(v, "$.entries")).join(last, [*DOCUMENT, "member"]).select(
        *DOCUMENT, F.explode(F.try_variant_get(v, "$.entries", "array<variant>")).alias("_v")).select(*DOCUMENT, F.struct(
            _good_cache_row(item).alias("ok"), F.try_variant_get(item, "$", CACHE_ITEM).alias("c")).alias("item")))
    judged = judge(docs.withColumn("whole", F.col("good")), items, (F.col("version") == 3) & F.col("entries")).withColumn(
        "state", F.when(F.col("good"), "current").when(F.col("whole") & F.col("version").isin(1, 2), "legacy").otherwise("broken"))
    fine = items.join(judged.filter("good").select(*DOCUMENT), DOCUMENT).select("project", "item.c")
    return _cache_rows(fine), _cache_findings(judged)


def read_cache(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Caches of any size, documents of one file each."""
    return cache_members(read_members(spark, path, **options))


STATE_COUNTS = ["completed_translations", "total_translations"]
STATE_FIELDS = ["status", "current_key", "current_locale", "last_processed_key", "last_processed_locale",
                "config_hash", "source_hash", "started_at", "updated_at"]


def parse_sync_state(docs: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved progress that still applies.  Malformed state is an error, outdated state a warning."""
    v = F.col("v")
    counts = [is_integer(v, f"$.{c}") & (F.try_variant_get(v, f"$.{c}", "double") >= 0) for c in STATE_COUNTS]
    times = [_instant(v, f"$.{c}") for c in ("started_at", "updated_at")]
    good = F.coalesce(counts[0] & counts[1] & times[0] & times[1], F.lit(False))
    judged = once(parse_once(docs, "v", F.col("text")), "good", good)
    flat = judged.filter("good").select(
        "project", "path",
        *[F.try_variant_get(v, f"$.{c}", "int").alias(c) for c in STATE_COUNTS],
        *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in STATE_FIELDS])
    kept, dropped = resume_state_filter(flat, fingerprints)
    return kept, union_diagnostics(
        diagnose(judged.filter(~F.col("good")).drop("v", "text"), "L10N_E0069"), dropped)


def read_sync_state(spark: SparkSession, path: str, fingerprints: DataFrame,
                    **options) -> tuple[DataFrame, DataFrame]:
    return parse_sync_state(read_documents(spark, path, **options), fingerprints)
