"""Whole jobs with all their outputs, reports in order, and comparisons of catalogs by hash trees."""

from __future__ import annotations

import dataclasses
from functools import cached_property

from pyspark.sql import functions as F

from contract.queries_core import AUDIT_VIEWS, GONE, JOINED, LINT, PLAN_VIEWS
from contract.queries_jobs import GROUP_VIEWS, _groups, now
from contract.registry import query
from contract.views import CTES, Lake, blank, parity
from lexilake.diagnostics import check_totals, has_errors
from lexilake.functions.text import is_blank
from lexilake.operators import applying, audit, hash_tree, linting
from lexilake.operators.coverage import platform_inventory
from lexilake.operators.planning import plan_sync
from lexilake.plans import audit as audit_plan
from lexilake.plans import rename as rename_plan
from lexilake.plans import review
from lexilake.plans import sync as sync_plan
from lexilake.providers import PLATFORM_FORMATS
from lexilake.session import shared_path, shuffled
from lexilake.sinks import platforms as native
from lexilake.sinks import reports
from lexilake.sinks.documents import write_files
from lexilake.sources.members import read_members
from lexilake.sources.rules import config_hashes
from lexilake.sources.xcstrings import xcstrings_versions


CACHE_COLUMNS = ["project", "source_hash", "locale", "config_hash", "model_version", "text", "cached_at"]


# --- a lake with open and blocked projects ---------------------------------------------------
class OpenLake(Lake):
    """All of the lake, whose projects their findings block, and each project once more, ten higher and without rules.

    The copies have every entry; those with a key in the source say it in words that keep its placeholders, but for
    blank ones that nobody reviewed.
    """

    def __init__(self, lake: Lake):
        super().__init__(lake.spark, lake.sf_dir)
        self.base = lake

    @staticmethod
    def twice(df):
        return df.unionByName(df.withColumn("project", F.col("project") + 10))

    @cached_property
    def source(self):
        return self.twice(self.base.source)

    @cached_property
    def locales(self):
        return self.twice(self.base.locales)

    @cached_property
    def configs(self):
        return self.twice(self.base.configs)

    @cached_property
    def cache(self):
        return self.twice(self.base.cache)

    @cached_property
    def rules(self):
        return self.base.rules

    @cached_property
    def entries(self):
        texts = self.base.parts.select("pk", F.col("text").alias("_source"))
        kept = F.startswith("key", F.lit("legacy.k")) | (is_blank(F.col("text")) & ~F.col("reviewed"))
        said = self.base.entries.join(shuffled(texts), "pk").withColumn("text", F.when(kept, F.col("text")).otherwise(
            F.concat(F.lit("["), "locale", F.lit("] "), "_source"))).drop("_source")
        return self.base.entries.unionByName(said.withColumn("project", F.col("project") + 10))


def _twice(name):
    return f"SELECT * FROM {name} UNION ALL SELECT * REPLACE ((project + 10)::INT AS project) FROM {name}"


OPEN_VIEWS = {
    **{f"w_{t}": CTES[f"v_{t}"] for t in ("source", "locales", "configs", "cache", "entries")},
    **{f"v_{t}": _twice(f"w_{t}") for t in ("source", "locales", "configs", "cache")},
    "v_entries": f"""SELECT * FROM w_entries UNION ALL SELECT * REPLACE ((project + 10)::INT AS project,
      CASE WHEN starts_with(key, 'legacy.k') OR ({blank('text')} AND NOT reviewed) THEN text ELSE '[' || locale || '] ' || src END AS text)
      FROM w_entries""",
}


# Answers to tasks: some fail, some lose a placeholder in projects of odd numbers, some are absent.
TASK_RESPONSES = """
  SELECT project, locale, key, CASE WHEN m = 1 AND project % 2 = 1 THEN replace(source_text, '{name}', '')
      ELSE '<' || locale || '> ' || source_text END AS text, CASE WHEN m = 2 THEN 'L10N_E0053' END AS error_code
  FROM (SELECT project, locale, key, source_text, length(source_text || locale) % 7 AS m FROM x_tasks WHERE cache_text IS NULL) WHERE m <> 3"""
TASK_OUTCOMES = f"""
  SELECT t.project, t.locale, t.key, t.source_hash, coalesce(t.cache_text, r.text) AS text, cache_model, cached_at,
    CASE WHEN t.cache_text IS NOT NULL THEN 'cached' WHEN r.error_code IS NOT NULL THEN 'failed' WHEN r.text IS NULL THEN 'unanswered'
         WHEN {parity('t.source_text', 'r.text')} THEN 'translated' ELSE 'mismatch' END AS outcome
  FROM x_tasks t LEFT JOIN x_responses r USING (project, locale, key)"""


def task_responses(lake, tasks):
    m = F.length(F.concat("source_text", "locale")) % 7
    asked = tasks.filter(F.col("cache_text").isNull()).join(
        shuffled(lake.source.select("project", "key", F.col("text").alias("source_text"))), ["project", "key"]).filter(m != 3)
    return asked.select(
        "project", "locale", "key", F.lit(0).cast("bigint").alias("response_no"),
        F.when((m == 1) & (F.col("project") % 2 == 1), F.replace("source_text", F.lit("{name}"), F.lit(""))).otherwise(
            F.concat(F.lit("<"), "locale", F.lit("> "), "source_text")).alias("text"),
        F.lit("r1").alias("model_version"), F.when(m == 2, "L10N_E0053").alias("error_code"))


@query("apply_responses_strict", """
  SELECT project, locale, key, text, outcome FROM x_outcomes o WHERE outcome IN ('cached', 'translated')
    AND NOT EXISTS (FROM x_outcomes m WHERE m.project = o.project AND m.outcome = 'mismatch')""",
       **PLAN_VIEWS, x_responses=TASK_RESPONSES, x_outcomes=TASK_OUTCOMES)
def apply_responses_strict(lake):
    """Every task of every project; those of odd numbers have answers without a placeholder and get nothing."""
    tasks = plan_sync(lake.source, lake.entries, lake.locales, lake.cache, lake.configs)
    entries, _, _ = applying.apply_responses(tasks, task_responses(lake, tasks), lake.source, lake.configs, "recorded", now(), True)
    return entries.select("project", "locale", "key", "text", F.when(F.col("model_version") == "r1", "translated").otherwise("cached").alias("outcome"))


SYNC_VIEWS = {
    **OPEN_VIEWS, "x_lint": LINT, "x_joined": JOINED, "x_gone": GONE,
    "x_targeted": "SELECT e.* FROM v_entries e SEMI JOIN v_targets USING (project, locale)",
    "x_blocked": f"""SELECT DISTINCT project FROM (SELECT project FROM x_lint WHERE level = 'error' UNION ALL
      SELECT project FROM x_joined SEMI JOIN v_targets USING (project, locale) WHERE NOT {parity('source_text', 'text')}
        AND CASE WHEN source_hash = expected THEN NOT {blank('text')} ELSE reviewed END)""",
    "x_pairs": PLAN_VIEWS["x_pairs"] + " WHERE s.project NOT IN (SELECT project FROM x_blocked)",
    "x_hits": PLAN_VIEWS["x_hits"], "x_tasks": PLAN_VIEWS["x_tasks"], "x_responses": TASK_RESPONSES, "x_outcomes": TASK_OUTCOMES,
    "x_done": "SELECT * FROM x_outcomes WHERE outcome IN ('cached', 'translated')",
    "x_fresh": """SELECT o.project, source_hash, locale, config_hash, 'r1' AS model_version, max(text) AS text,
        TIMESTAMP '2024-05-01 12:34:56' AS cached_at
      FROM x_outcomes o JOIN v_configs USING (project) WHERE outcome = 'translated' GROUP BY ALL""",
    "x_upserted": """SELECT c.* FROM v_cache c ANTI JOIN x_fresh USING (project, source_hash, locale, config_hash, model_version)
      WHERE project NOT IN (SELECT project FROM x_blocked) UNION ALL SELECT * FROM x_fresh""",
    "x_archive": """
      SELECT a.*, locale || '-20240501123456' || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS archive_name FROM (
        SELECT project, locale, key, text, reason, dense_rank() OVER (PARTITION BY locale ORDER BY project) - 1 AS n FROM (
          SELECT project, locale, key, text, 'locale' AS reason FROM v_entries e ANTI JOIN v_targets USING (project, locale)
            WHERE project NOT IN (SELECT project FROM x_blocked)
          UNION ALL SELECT project, locale, key, text, 'key' FROM x_gone SEMI JOIN v_targets USING (project, locale)
            WHERE reviewed AND project NOT IN (SELECT project FROM x_blocked))) a""",
}


@query("apply_sync", """
  SELECT 'entry' AS kind, project, locale, key, text, provider || ' ' || reviewed || ' ' || stale AS detail FROM (
    SELECT e.* FROM v_entries e WHERE project IN (SELECT project FROM x_blocked)
    UNION ALL SELECT e.* REPLACE (CASE WHEN e.reviewed AND e.source_hash <> s.source_hash THEN true
        WHEN e.source_hash = s.source_hash THEN false ELSE e.stale END AS stale)
      FROM x_targeted e JOIN v_source s ON s.project = e.project AND s.key = e.key
      WHERE e.project NOT IN (SELECT project FROM x_blocked) AND NOT EXISTS (
        FROM x_done d WHERE d.project = e.project AND d.locale = e.locale AND d.key = e.key))
  UNION ALL SELECT 'entry', project, locale, key, text, 'recorded false false' FROM x_done
  UNION ALL SELECT 'cache', project, locale, source_hash, text, model_version || ' ' || cached_at FROM (
    SELECT * FROM v_cache WHERE project IN (SELECT project FROM x_blocked)
    UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project, source_hash, locale, config_hash
        ORDER BY cached_at DESC, model_version DESC, text DESC) AS rn FROM x_upserted SEMI JOIN v_source USING (project, source_hash)) WHERE rn <= 2)
  UNION ALL SELECT 'archive', project, locale, key, text, reason || ' ' || archive_name FROM x_archive
  UNION ALL SELECT 'removed', project, locale, key, text, '' FROM x_gone SEMI JOIN v_targets USING (project, locale)
    WHERE NOT reviewed AND project NOT IN (SELECT project FROM x_blocked)
  UNION ALL SELECT 'history', project, locale, archive_name, CASE WHEN bool_or(reason = 'locale') THEN 'remove_locale' ELSE 'archive_entries' END,
    count(*)::VARCHAR FROM x_archive GROUP BY project, locale, archive_name
  UNION ALL SELECT 'finding', project, locale, key, NULL, CASE outcome WHEN 'mismatch' THEN 'L10N_E0041' WHEN 'failed' THEN 'L10N_E0053'
      ELSE 'L10N_E0081' END FROM x_outcomes WHERE outcome NOT IN ('cached', 'translated')
  UNION ALL SELECT 'finding', project, locale, key, NULL, 'L10N_E0083' FROM x_archive WHERE reason = 'key'
  UNION ALL SELECT 'finding', project, locale, key, NULL, 'L10N_E0090' FROM x_joined SEMI JOIN v_targets USING (project, locale)
    WHERE source_hash <> expected AND reviewed AND project NOT IN (SELECT project FROM x_blocked)
  UNION ALL SELECT 'blocked', project, NULL, NULL, NULL, '' FROM x_blocked""", **SYNC_VIEWS)
def apply_sync(lake):
    """All that a run leaves: entries, cache, archive, removed, history and findings, of open and of blocked projects."""
    lake = OpenLake(lake)
    c = dataclasses.replace(lake.catalog, entries=lake.entries.drop("pk"), cache=lake.cache.select(*CACHE_COLUMNS))
    tasks = plan_sync(c.source, audit.configured(c.entries, c.locales), c.locales, c.cache, c.configs)
    done = sync_plan.apply_sync(c, task_responses(lake, tasks), "recorded", now())
    blocked = has_errors(done.diagnostics.filter("code NOT IN ('L10N_E0053', 'L10N_E0081') AND project < 10")).filter("not ok")
    none = F.lit(None).cast("string")
    row = lambda kind, key, text, detail: [
        F.lit(kind).alias("kind"), "project", "locale", F.col(key).alias("key"), text.alias("text"), detail.alias("detail")]
    flags = F.concat_ws(" ", "provider", F.col("reviewed").cast("string"), F.col("stale").cast("string"))
    parts = [
        done.entries.select(*row("entry", "key", F.col("text"), flags)),
        done.cache.select(*row("cache", "source_hash", F.col("text"), F.concat_ws(" ", "model_version", F.col("cached_at").cast("string")))),
        done.archive.select(*row("archive", "key", F.col("text"), F.concat_ws(" ", "reason", "archive_name"))),
        done.removed.select(*row("removed", "key", F.col("text"), F.lit(""))),
        done.history.select(*row("history", "archive_name", F.col("op"), F.col("entries").cast("string"))),
        done.diagnostics.filter("project >= 10").select(*row("finding", "key", none, F.col("code"))),
        blocked.select(F.lit("blocked").alias("kind"), "project", none.alias("locale"), none.alias("key"), none.alias("text"), F.lit("").alias("detail"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- renaming one key ------------------------------------------------------------------------
@query("rename_one", """
  SELECT 'entry' AS kind, project, locale, CASE WHEN project = 11 AND key = f THEN 'renamed.key' ELSE key END AS key, text FROM v_entries, x_first_key
  UNION ALL SELECT 'source', project, locale, CASE WHEN project = 11 AND key = f THEN 'renamed.key' ELSE key END, text FROM v_source, x_first_key
  UNION ALL SELECT 'blocked', 1, NULL, 'L10N_E0069', NULL UNION ALL SELECT 'blocked', 12, NULL, 'L10N_E0069', NULL""",
       **OPEN_VIEWS, x_first_key="SELECT min(key) AS f FROM v_source WHERE pk % 5 = 1")
def rename_one(lake):
    """One key of a project without errors is renamed; a key of one with errors, and one to a name that is taken, are not."""
    lake = OpenLake(lake)
    source, entries = lake.source.drop("pk"), lake.entries.drop("pk")
    known = lake.base.source.filter(F.col("pk") % 5 == 1).agg(F.min("key")).first()[0]
    taken = lake.base.source.agg(F.max("key")).first()[0]
    found = None
    for project, from_, to in ((11, known, "renamed.key"), (1, "no.such.key", "renamed.key"), (12, known, taken)):
        source, entries, diags = rename_plan.rename_one(source, entries, lake.rules, project, from_, to)
        hit = diags.filter("code = 'L10N_E0069'").select(
            F.lit("blocked").alias("kind"), "project", F.lit(None).cast("string").alias("locale"), F.col("code").alias("key"),
            F.lit(None).cast("string").alias("text"))
        found = hit if found is None else found.unionByName(hit)
    columns = ["project", "locale", "key", "text"]
    return entries.select(F.lit("entry").alias("kind"), *columns).unionByName(
        source.select(F.lit("source").alias("kind"), *columns)).unionByName(found)


# --- reports ---------------------------------------------------------------------------------
@query("diagnostics_report", """
  SELECT row_number() OVER (ORDER BY code, project, locale NULLS FIRST, key, details) AS position, project, code, locale, key, details, true AS in_order
  FROM (SELECT project, code, NULL AS locale, key, details FROM x_lint UNION ALL SELECT project, code, locale, key, '' FROM x_missing)""",
       **AUDIT_VIEWS)
def diagnostics_report(lake):
    """Key and missing findings as a written report: numbered, and in order within its files and from file to file."""
    from lexilake.operators.audit import check_missing

    lint = linting.lint_keys(lake.source, lake.rules)
    found = lint.unionByName(check_missing(lake.source, audit.configured(lake.entries, lake.locales), lake.locales))
    path = shared_path(lake.spark, "report")
    reports.write_report(found, path)
    rows = lake.spark.read.schema("position bigint, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in found.schema)).json(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.min("position").alias("low"), F.max("position").alias("high")).agg(
        F.array_sort(F.collect_list(F.struct("file", "low", "high"))).alias("f"))
    in_order = files.select(F.forall(F.zip_with(
        F.slice("f", 1, F.size("f") - 1), F.slice("f", 2, F.size("f")), lambda a, b: b["low"].isNull() | (a["high"] < b["low"])),
        lambda x: F.coalesce(x, F.lit(True)))).first()[0]
    details = F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")
    return rows.select("position", "project", "code", "locale", "key", F.coalesce(details, F.lit("")).alias("details"),
                       F.lit(in_order).alias("in_order"))


@query("check_totals", """
  SELECT project, s.n AS source_keys, l.n AS locales_checked, NOT EXISTS (FROM x_audit a WHERE a.project = s.project) AS ok
  FROM (SELECT project, count(*) AS n FROM v_source GROUP BY 1) s JOIN (SELECT project, count(DISTINCT locale) AS n FROM v_targets GROUP BY 1) l
  USING (project)""", **AUDIT_VIEWS)
def check_totals_query(lake):
    return check_totals(lake.source, lake.locales, audit_plan.audit_catalog(lake.catalog))


@query("coverage_report", """
  SELECT 'locales' AS part, project, locale AS name, total_entries AS n FROM (
    SELECT t.project, t.locale, count(e.key) AS total_entries FROM v_targets t LEFT JOIN v_entries e USING (project, locale) GROUP BY ALL)
  UNION ALL SELECT 'requests', project, NULL, count(*) FROM x_tasks WHERE cache_text IS NULL GROUP BY project
  UNION ALL SELECT 'history', project, max(id), count(*) FROM v_history GROUP BY project
  UNION ALL SELECT 'platforms', project, platform, count(DISTINCT key) FILTER (locale = 'en') FROM v_platform GROUP BY ALL""", **PLAN_VIEWS)
def coverage_report(lake):
    report = audit_plan.coverage_report(lake.catalog)
    n = lambda c: F.col(c).cast("bigint").alias("n")
    return report["locales"].select(F.lit("locales").alias("part"), "project", F.col("locale").alias("name"), n("total_entries")).unionByName(
        report["requests"].select(F.lit("requests").alias("part"), "project", F.lit(None).cast("string").alias("name"), n("requests"))).unionByName(
        lake.history.groupBy("project").agg(F.max("id").alias("name")).join(report["history"], "project").select(
            F.lit("history").alias("part"), "project", "name", n("entries"))).unionByName(
        report["platforms"].select(F.lit("platforms").alias("part"), "project", F.col("platform").alias("name"), n("key_count")))


@query("dedupe_report", """
  SELECT 'exact' AS part, project, key, NULL AS other FROM x_exact
  UNION ALL SELECT 'cleaned', project, canonical_key, duplicate_key FROM x_cleaned
  UNION ALL SELECT 'keys', project, count(*)::VARCHAR, NULL FROM v_source GROUP BY project""", **GROUP_VIEWS)
def dedupe_report(lake):
    exact, cleaned, summary, _ = review.dedupe_report(lake.source, groups=_groups(lake))
    none = F.lit(None).cast("string").alias("other")
    return exact.select(F.lit("exact").alias("part"), "project", "key", none).unionByName(cleaned.select(
        F.lit("cleaned").alias("part"), "project", F.col("canonical_key").alias("key"), F.col("duplicate_key").alias("other"))).unionByName(
        summary.select(F.lit("keys").alias("part"), "project", F.col("source_keys").cast("string").alias("key"), none))


@query("inventory_versions", """
  SELECT project, platform, count(DISTINCT key) FILTER (locale = 'en') AS key_count, CASE WHEN platform = 'ios' THEN '1.0' END AS version
  FROM v_platform GROUP BY ALL""")
def inventory_versions(lake):
    """Inventories with the format version that the projects' own documents state, read from their files."""
    entries = lake.platform_entries.drop("pk").filter("platform = 'ios'")
    path = shared_path(lake.spark, "xcstrings")
    write_files(native.export_xcstrings(entries, "L.xcstrings").select("project", "section", "sort_key", "fragment"), ["project"], path)
    versions = xcstrings_versions(read_members(lake.spark, path, project_pattern=r"/project=(\d+)/"))
    return platform_inventory(lake.platform_entries, lake.locales, versions).drop("locales")


PLURAL = "regexp_matches({0}, '\\{{\\s*[\\w.-]+\\s*,\\s*plural\\s*,')"


@query("import_files", f"""
  SELECT kind, project, locale, key, text, NULL::BIGINT AS n FROM x_imported
  UNION ALL SELECT 'source', project, locale, key, text, NULL FROM x_plain WHERE locale = 'en'
  UNION ALL SELECT 'report', t.project, t.locale, NULL, NULL, count(i.key) FROM v_targets t
    LEFT JOIN x_imported i ON i.project = t.project AND i.locale = t.locale AND i.kind = 'entry' GROUP BY ALL""",
       x_plain=f"SELECT * FROM v_platform WHERE NOT {PLURAL.format('text')}",
       x_imported=f"""
  SELECT CASE WHEN {parity('s.text', 'p.text')} THEN 'entry' ELSE 'L10N_E0041' END AS kind, p.project, p.locale, p.key, p.text
  FROM x_plain p SEMI JOIN v_targets USING (project, locale)
  JOIN (SELECT project, key, text FROM x_plain WHERE locale = 'en') s ON s.project = p.project AND s.key = p.key
  WHERE NOT {blank('p.text')}""")
def import_files(lake):
    """What platforms hold, written as one string catalog a project, read from those files and taken over."""
    platform = lake.platform_entries.drop("pk").withColumn("platform", F.lit("ios"))
    path = shared_path(lake.spark, "native")
    form = PLATFORM_FORMATS["ios_xcstrings"]
    write_files(form.export(platform, "L.xcstrings").select("project", "section", "sort_key", "fragment"), ["project"], path)
    done = sync_plan.import_files(lake.spark, path, "ios_xcstrings", lake.locales, now(), project_pattern=r"/project=(\d+)/")
    none, n = F.lit(None).cast("string"), F.lit(None).cast("bigint").alias("n")
    texts = platform.select("project", "locale", "key", "text")
    columns = ["project", "locale", "key", "text"]
    mismatch = done.diagnostics.filter("code = 'L10N_E0041'").select("project", "locale", "key", F.col("code").alias("kind")).join(
        shuffled(texts), ["project", "locale", "key"])
    return done.entries.select(F.lit("entry").alias("kind"), *columns, n).unionByName(
        done.source.select(F.lit("source").alias("kind"), *columns, n)).unionByName(mismatch.select("kind", *columns, n)).unionByName(
        done.report.select(F.lit("report").alias("kind"), "project", "locale", none.alias("key"), none.alias("text"), F.col("imported").alias("n")))


# --- hashes ----------------------------------------------------------------------------------
@query("config_hashes", r"""
  SELECT c_custkey::INT AS project, 'sha256:' || sha256('{' || chr(10) || '  "glossary": ' || CASE WHEN c_custkey % 3 = 0 THEN '{}' ELSE
      '{' || chr(10) || '    "a' || c_name || '": {' || chr(10) || '      "de": "' || c_mktsegment || '",' || chr(10) || '      "fr": "x\"y"' || chr(10)
      || '    },' || chr(10) || '    "b": {}' || chr(10) || '  }' END || ',' || chr(10)
    || CASE WHEN c_custkey % 2 = 0 THEN '  "model": "m' || c_nationkey || '",' || chr(10) ELSE '' END
    || '  "type": "' || c_mktsegment || '"' || chr(10) || '}' || chr(10)) AS config_hash FROM customer""")
def config_hashes_query(lake):
    """A configuration for each customer: terms of a glossary, perhaps a model."""
    terms = F.map_from_arrays(F.array(F.lit("b"), F.concat(F.lit("a"), "c_name")), F.array(
        F.create_map().cast("map<string,string>"), F.create_map(F.lit("fr"), F.lit('x"y'), F.lit("de"), F.col("c_mktsegment"))))
    rows = lake.table("customer").select(
        F.col("c_custkey").cast("int").alias("project"), F.col("c_mktsegment").alias("provider_type"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("m"), F.col("c_nationkey").cast("string"))).alias("model"),
        F.when(F.col("c_custkey") % 3 != 0, terms).alias("glossary"))
    return config_hashes(rows)


@query("changed_keys", """
  SELECT project, key, 'changed' AS change FROM v_source WHERE pk % 50 = 7 AND pk % 90 <> 11
  UNION ALL SELECT project, key, 'removed' FROM v_source WHERE pk % 90 = 11
  UNION ALL SELECT project, 'new.' || key, 'added' FROM v_source WHERE pk % 120 = 5""")
def changed_keys(lake):
    """A catalog against itself with keys changed, removed and added, by two hash trees."""
    pk, before = F.col("pk"), lake.source.select("project", "key", "source_hash", "pk")
    after = before.filter(pk % 90 != 11).withColumn("source_hash", F.when(
        pk % 50 == 7, F.concat("source_hash", F.lit("x"))).otherwise(F.col("source_hash"))).unionByName(
        before.filter(pk % 120 == 5).withColumn("key", F.concat(F.lit("new."), "key")))
    return hash_tree.changed_keys(before.drop("pk"), after.drop("pk"), depth=2)
