"""Whole lakes written and read back: catalogs in parts, files of any size, logs by line, snapshots by content."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.queries_formats import _stream
from contract.registry import query
from contract.views import Lake
from lexilake.functions.escape import json_string
from lexilake.operators import history_entries, restoring
from lexilake.session import durable, shared_path
from lexilake.sinks import catalogs as sink
from lexilake.sinks import snapshots
from lexilake.sinks.documents import write_files
from lexilake.sources import catalogs, history
from lexilake.streaming import watch
from lexilake.schemas import CACHE, HISTORY

ENTRY_COLUMNS = "project, locale, key, text, reviewed, stale, source_hash, provider, model_version, translated_at"
PROJECT = r"/project=(\d+)/"


# --- catalogs --------------------------------------------------------------------------------
@query("catalogs_in_parts", f"""
  SELECT {ENTRY_COLUMNS}, '' AS code FROM v_entries""")
def catalogs_in_parts(lake):
    """Every entry, written as documents in many parts and read back by their manifest."""
    path = shared_path(lake.spark, "catalogs")
    sink.write_catalogs(lake.entries, path, parts=24)
    rows, bad = catalogs.read_translations(lake.spark, path)
    columns = ENTRY_COLUMNS.split(", ")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns if c not in ("project", "locale", "key")]
    return rows.select(*columns, F.lit("").alias("code")).unionByName(bad.select("project", "locale", "key", *none, "code"))


@query("sources_in_parts", "SELECT project, locale, key, text, description, source_hash FROM v_source")
def sources_in_parts(lake):
    path = shared_path(lake.spark, "sources")
    sink.write_sources(lake.source, path, parts=24)
    rows, bad = catalogs.read_source_catalogs(lake.spark, path)
    return rows.select("project", "locale", "key", "text", "description", "source_hash").unionByName(bad.select(
        "project", "locale", "key", F.col("code").alias("text"), F.col("path").alias("description"), F.col("level").alias("source_hash")))


@query("catalog_manifest", """
  SELECT project, locale, count(*)::BIGINT AS entries, true AS in_order FROM v_entries GROUP BY 1, 2""")
def catalog_manifest(lake):
    """Parts of a document have ranges of keys that follow each other, and hold every entry and both ends."""
    path = shared_path(lake.spark, "catalogs")
    sink.write_catalogs(lake.entries, path, parts=24)
    parts = lake.spark.read.parquet(f"{path}/_manifest")
    ranges = F.array_sort(F.collect_list(F.struct("part", F.collate("first_key", "UNICODE").alias("low"), F.collate("last_key", "UNICODE").alias("high"))))
    whole = parts.groupBy("project", "locale").agg((F.sum("fragments") - 2).cast("bigint").alias("entries"), ranges.alias("r"))
    keyed = F.filter("r", lambda p: p["low"].isNotNull())
    return whole.select("project", "locale", "entries", F.forall(F.zip_with(
        F.slice(keyed, 1, F.size(keyed) - 1), F.slice(keyed, 2, F.size(keyed)), lambda a, b: b["low"].isNull() | (a["high"] < b["low"])),
        lambda x: F.coalesce(x, F.lit(True))).alias("in_order"))


@query("read_catalog_files", f"""
  SELECT {ENTRY_COLUMNS}, '' AS code FROM v_entries WHERE locale <> 'de'
  UNION ALL SELECT DISTINCT project, locale, NULL, NULL, NULL::BOOLEAN, NULL::BOOLEAN, NULL, NULL, NULL, NULL::TIMESTAMP, 'L10N_E0011'
  FROM v_entries WHERE locale = 'de'""")
def read_catalog_files(lake):
    """One file a catalog, each read by as many tasks as it has blocks; those of one locale are cut short at the end."""
    path = shared_path(lake.spark, "files")
    fragments = sink.render_catalog(lake.entries).filter("NOT (locale = 'de' AND section = 2)")
    write_files(fragments, ["project", "locale"], path)
    rows, bad = catalogs.read_translations(lake.spark, path, project_pattern=PROJECT)
    columns = ENTRY_COLUMNS.split(", ")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns if c not in ("project", "locale")]
    return rows.select(*columns, F.lit("").alias("code")).unionByName(bad.select(
        "project", F.regexp_extract("path", "/locale=([^/]*)/", 1).alias("locale"), *none, "code"))


@query("cache_round_trip", """
  SELECT project, source_hash, locale, config_hash, model_version, text, cached_at FROM v_cache""")
def cache_round_trip(lake):
    path = shared_path(lake.spark, "cache")
    sink.write_cache(lake.cache, path)
    return lake.spark.read.schema(CACHE).parquet(path)


# --- history ---------------------------------------------------------------------------------
LOG_LINES = """
  SELECT (event_id % 4)::INT AS project, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line, event_id FROM events"""


@query("history_by_line", """
  SELECT project, line AS line_no, event_id::VARCHAR AS id, '' AS code FROM x_log_lines WHERE project <> 3
  UNION ALL SELECT 2, count(*) + 1, NULL, 'L10N_E0078' FROM x_log_lines WHERE project = 2
  UNION ALL SELECT 3, 1, NULL, 'L10N_E0062' FROM x_log_lines WHERE project = 3 HAVING count(*) > 0""", x_log_lines=LOG_LINES)
def history_by_line(lake):
    """One log a project, as one file; one ends in a cut line, one has a bad line before others."""
    row = F.concat(F.lit('{"id": '), json_string(F.col("event_id").cast("string")),
                   F.lit(', "op": "sync", "actor": "a", "ts": "2024-01-01T00:00:00.000Z", "summary": "s, t"}'))
    project = (F.col("event_id") % 4).cast("int").alias("project")
    events = lake.table("events").select(project, F.format_string("%020d", "event_id").alias("sort_key"), F.lit(1).alias("section"), row.alias("fragment"))
    ends = events.select("project").distinct().select(
        "project", F.lit("").alias("sort_key"), F.when(F.col("project") == 2, 2).otherwise(0).alias("section"),
        F.when(F.col("project") == 2, '{"id": "x", "op": "syn').otherwise('{"id": 5}').alias("fragment")).filter("project > 1")
    path = shared_path(lake.spark, "logs")
    write_files(events.unionByName(ends), ["project"], path)
    rows, found = history.read_history(lake.spark, path, project_pattern=PROJECT)
    return rows.select("project", "line_no", "id", F.lit("").alias("code")).unionByName(found.select(
        "project", F.col("details")["line"].cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("id"), "code"))


OPS = """
  SELECT * FROM (VALUES (0, 'init'), (1, 'sync'), (2, 'import'), (3, 'rename'), (4, 'lint_fix'), (5, 'rollback'), (6, 'delete'),
    (7, 'add_locale'), (8, 'remove_locale'), (9, 'repair')) AS t(n, op)"""


@query("history_append", """
  SELECT (e.event_id % 4)::INT AS project, strftime(ts, '%Y%m%d%H%M%S') || '-' || replace(op, '_', '-') AS id, op, e.user_id::VARCHAR AS actor,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts,
    CASE WHEN op IN ('init', 'sync', 'import', 'repair') THEN event_type END AS summary, CASE WHEN op = 'import' THEN 'android' END AS "from",
    CASE WHEN op = 'rename' THEN 'k' || e.event_id END AS before, CASE WHEN op = 'rename' THEN 'n' || e.event_id END AS after,
    CASE WHEN op = 'delete' THEN 'k' || e.event_id END AS key, CASE WHEN op IN ('add_locale', 'remove_locale') THEN 'de' END AS locale,
    CASE WHEN op = 'rollback' THEN 'h' || e.event_id END AS "to", CASE WHEN op = 'lint_fix' THEN (e.event_id % 9)::INT END AS files_updated,
    CASE WHEN op = 'lint_fix' THEN 'k' || e.event_id || '>n' || e.event_id ELSE '' END AS renames
  FROM events e JOIN x_ops o ON o.n = e.event_id % 10""", x_ops=OPS)
def history_append(lake):
    """An entry of every kind, appended to logs and read back through the log's reader."""
    events = lake.table("events").select(
        (F.col("event_id") % 4).cast("int").alias("project"), F.col("event_id").alias("e"), F.col("ts").cast("timestamp_ntz").alias("at"),
        F.col("user_id").cast("string").alias("user"), "event_type")
    of = lambda n: events.filter(F.col("e") % 10 == n)
    user, kind, e = F.col("user"), F.col("event_type"), F.col("e").cast("string")
    key, new = F.concat(F.lit("k"), e), F.concat(F.lit("n"), e)
    h = history_entries
    made = [
        h.init_entry(of(0), user, kind), h.sync_entry(of(1), user, kind), h.import_entry(of(2), user, "android", kind),
        h.rename_entry(of(3), user, key, new),
        h.lint_fix_entry(of(4), user, F.array(F.struct(key.alias("before"), new.alias("after"))), F.col("e") % 9),
        h.rollback_entry(of(5), user, F.concat(F.lit("h"), e)), h.delete_entry(of(6), user, key), h.add_locale_entry(of(7), user, "de"),
        h.remove_locale_entry(of(8), user, "de"), h.repair_entry(of(9), user, kind)]
    path = shared_path(lake.spark, "history")
    for rows in made:
        sink.append_history(rows, path)
    rows, _ = history.read_history(lake.spark, path, project_pattern=PROJECT)
    columns = [c.split(" ")[0].strip("`") for c in HISTORY.split(", ") if not c.startswith("renames")]
    return rows.select("project", *columns, F.coalesce(F.array_join(F.transform("renames", lambda r: F.concat_ws(
        ">", r["before"], r["after"])), ","), F.lit("")).alias("renames"))


# --- snapshots -------------------------------------------------------------------------------
SNAPSHOT_FILES = """
  SELECT project, 'l10n/' || locale || '/' || key AS path, CASE WHEN pk % 6 <> 0 THEN text END AS first,
    CASE WHEN pk % 10 = 0 THEN text || ' (new)' WHEN pk % 6 <> 0 AND pk % 7 <> 0 THEN text END AS second FROM v_entries"""


def _snapshots(lake):
    """Two snapshots of every entry's file, of which a tenth change and some come or go; and where they are."""
    pk, text = F.col("pk"), F.col("text")
    # Stored, as files are: each snapshot reads them several times.
    named = durable(lake.entries.select("project", F.concat_ws("/", F.lit("l10n"), "locale", "key").alias("path"), "text", "pk"))
    first = named.filter(pk % 6 != 0).select("project", "path", text.alias("content"))
    second = named.filter((pk % 10 == 0) | ((pk % 6 != 0) & (pk % 7 != 0))).select(
        "project", "path", F.when(pk % 10 == 0, F.concat(text, F.lit(" (new)"))).otherwise(text).alias("content"))
    managed = durable(restoring.managed_files(first, second, named))
    path = shared_path(lake.spark, "snapshots")
    for files, name in ((first, "h1"), (second, "h2"), (second, "h2")):
        snapshots.write_snapshot(restoring.snapshot_tables(files, managed, name), path)
    return path, second


@query("snapshot_blobs", """
  SELECT 'blobs' AS kind, count(DISTINCT content) AS n FROM (SELECT first AS content FROM x_shots UNION ALL SELECT second FROM x_shots)
  UNION ALL SELECT 'h1', count(*) FROM x_shots UNION ALL SELECT 'h2', count(*) FROM x_shots
  UNION ALL SELECT 'changed', count(*) FROM x_shots WHERE first IS DISTINCT FROM second""", x_shots=SNAPSHOT_FILES)
def snapshot_blobs(lake):
    """Each content is stored once, whatever the snapshots, and a repeated one adds nothing."""
    path, _ = _snapshots(lake)
    manifests = snapshots.read_manifests(lake.spark, path)
    one = lambda h: manifests.filter(F.col("history_id") == h)
    counted = [("blobs", snapshots.read_blobs(lake.spark, path)), ("changed", snapshots.difference(one("h1"), one("h2")))]
    out = manifests.groupBy(F.col("history_id").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    for kind, rows in counted:
        out = out.unionByName(rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")))
    return out


@query("snapshot_restore", """
  SELECT project, path, CASE WHEN first IS NULL THEN 'delete' ELSE 'write' END AS action, first AS content FROM x_shots
  WHERE first IS DISTINCT FROM second""", x_shots=SNAPSHOT_FILES)
def snapshot_restore(lake):
    path, now = _snapshots(lake)
    return snapshots.restore_plan(lake.spark, path, "h1", now)


# --- streams ---------------------------------------------------------------------------------
@query("stalled_by_timer", """
  SELECT project, min(seen) AS started_at, max(seen) + INTERVAL 10 MINUTE AS stalled_at, count(*) AS reports FROM (
    SELECT project, seen, sum(fresh) OVER (PARTITION BY project ORDER BY seen ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT project, updated_at AS seen, CASE WHEN updated_at > lag(updated_at) OVER (
        PARTITION BY project ORDER BY updated_at) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM v_states))
  GROUP BY project, run
  HAVING max(seen) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stalled_by_timer(lake):
    """Runs that stopped reporting, each by the timer of its state."""
    home = shared_path(lake.spark, "stream")
    stream = watch.watch_runs(Lake.states_of(_stream(lake, "events")))
    watch.start_with_state(lake.spark, lambda: stream.writeStream.foreachBatch(
        lambda rows, i: rows.write.mode("overwrite").parquet(f"{home}/rows/batch={i}")).option(
        "checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()).awaitTermination()
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return lake.spark.read.schema(watch.STALLED).parquet(f"{home}/rows").select("project", at("started_at"), at("stalled_at"), "reports")


@query("entries_upsert_stream", """
  SELECT project, locale, key, text FROM v_entries e WHERE NOT EXISTS (
    FROM v_parts p WHERE p.pk % 3 = 0 AND p.pk % 4 = e.project AND e.locale = 'de' AND p.key = e.key)
  UNION ALL SELECT (pk % 4)::INT, 'de', key, 'new: ' || text FROM v_parts WHERE pk % 3 = 0""")
def entries_upsert_stream(lake):
    """New entries as a stream into the table of all; then its first batch once more, with other texts, which changes nothing."""
    home = shared_path(lake.spark, "entries")
    lake.entries.drop("pk").write.partitionBy("project", "locale").parquet(f"{home}/table")

    def entries_of(parts):
        return parts.filter(F.col("pk") % 3 == 0).select(
            (F.col("pk") % 4).cast("int").alias("project"), F.lit("de").alias("locale"), "key", F.concat(F.lit("new: "), "text").alias("text"),
            F.lit(False).alias("reviewed"), F.lit(False).alias("stale"), "source_hash", F.lit("stream").alias("provider"),
            F.lit("m").alias("model_version"), F.expr("timestamp_ntz'2024-05-01 12:34:56'").alias("translated_at"))

    watch.upsert_stream(entries_of(Lake.parts_of(_stream(lake, "part"))), f"{home}/table", f"{home}/checkpoint").awaitTermination()
    replayed = entries_of(lake.parts).withColumn("text", F.lit("replayed"))
    watch.upsert_into(lake.spark, f"{home}/table", replayed, 0)
    return lake.spark.read.parquet(f"{home}/table").select("project", "locale", "key", "text")
