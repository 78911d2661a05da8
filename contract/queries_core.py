"""Planning, freshness, audit, cache and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.registry import flat, query
from contract.views import Lake, blank, names, parity, signature, used_placeholders
from lexilake.diagnostics import check_summary, has_errors
from lexilake.functions.text import extract_placeholders, has_parity
from lexilake.operators import audit, cache, coverage, linting, planning, ranking, rows
from lexilake.plans import audit as audit_plan
from lexilake.session import shuffled
from lexilake.sources.rules import CONFIG, project_rules

# --- shared SQL ------------------------------------------------------------------------------
PAIRS = f"""
  SELECT s.project, t.locale, s.key, s.source_hash, s.text AS source_text,
    CASE WHEN {blank('e.text')} THEN 'missing' WHEN e.source_hash = s.source_hash THEN 'current'
         WHEN e.reviewed THEN 'reviewed_stale' ELSE 'stale' END AS reason
  FROM v_source s JOIN v_targets t ON t.project = s.project
  LEFT JOIN v_entries e ON e.project = s.project AND e.locale = t.locale AND e.key = s.key"""
HITS = """
  SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY project, source_hash, locale
      ORDER BY cached_at DESC, model_version DESC, text DESC) AS rn
    FROM v_cache c SEMI JOIN v_configs USING (project, config_hash)) WHERE rn = 1"""
TASKS = """
  SELECT p.*, h.text AS cache_text, h.model_version AS cache_model, h.cached_at
  FROM x_pairs p LEFT JOIN x_hits h USING (project, source_hash, locale) WHERE reason IN ('missing', 'stale')"""
PLAN = """
  SELECT p.project, p.locale, count(*) FILTER (reason = 'missing') AS missing,
    count(*) FILTER (reason = 'stale') AS stale_retranslations,
    count(*) FILTER (reason = 'reviewed_stale') AS reviewed_stale,
    coalesce(any_value(g.n), 0)::BIGINT AS removed,
    count(*) FILTER (reason IN ('missing', 'stale') AND h.text IS NOT NULL) AS cache_hits,
    count(*) FILTER (reason IN ('missing', 'stale')) AS pending
  FROM x_pairs p LEFT JOIN x_hits h USING (project, source_hash, locale)
  LEFT JOIN (SELECT project, locale, count(*) AS n FROM v_entries e
             WHERE NOT EXISTS (FROM v_source s WHERE s.project = e.project AND s.key = e.key) GROUP BY ALL) g
    ON g.project = p.project AND g.locale = p.locale
  GROUP BY ALL"""
TOTALS = """
  SELECT project, NULL AS locale, sum(missing)::BIGINT AS missing,
    sum(stale_retranslations)::BIGINT AS stale_retranslations, sum(reviewed_stale)::BIGINT AS reviewed_stale,
    sum(removed)::BIGINT AS removed, sum(cache_hits)::BIGINT AS cache_hits, sum(pending)::BIGINT AS pending
  FROM x_plan GROUP BY project"""
PLAN_VIEWS = {"x_pairs": PAIRS, "x_hits": HITS, "x_tasks": TASKS, "x_plan": PLAN, "x_totals": TOTALS}
JOINED = "SELECT e.*, s.text AS source_text, s.source_hash AS expected, s.ph FROM v_entries e JOIN v_source s " \
         "ON s.project = e.project AND s.key = e.key"
GONE = "SELECT e.* FROM v_entries e WHERE NOT EXISTS (FROM v_source s WHERE s.project = e.project AND s.key = e.key)"


def tasks_of(lake: Lake):
    return planning.plan_sync(lake.source, lake.entries, lake.locales, lake.cache, lake.configs)


def plan_of(lake: Lake):
    return planning.plan_summary(lake.source, lake.entries, lake.locales, lake.cache, lake.configs)


# --- planning --------------------------------------------------------------------------------
@query("plan_summary", "SELECT * FROM x_plan UNION ALL SELECT * FROM x_totals", **PLAN_VIEWS)
def plan_summary(lake):
    return plan_of(lake)


@query("sync_tasks", "SELECT project, locale, key, reason, source_hash FROM x_pairs "
                     "WHERE reason IN ('missing', 'stale')", **PLAN_VIEWS)
def sync_tasks(lake):
    pairs = planning.classify_pairs(lake.source, lake.entries, lake.locales)
    return pairs.filter(F.col("reason").isin("missing", "stale")).select(
        "project", "locale", "key", "reason", "source_hash")


@query("cache_lookup", "SELECT project, locale, key, reason, cache_text, cache_model, cached_at FROM x_tasks",
       **PLAN_VIEWS)
def cache_lookup(lake):
    return tasks_of(lake).drop("source_hash")


@query("uncached_requests", "SELECT project, locale, key FROM x_tasks WHERE cache_text IS NULL", **PLAN_VIEWS)
def uncached_requests(lake):
    return planning.uncached_requests(tasks_of(lake)).select("project", "locale", "key")


@query("estimate_requests", "SELECT project, count(*) AS requests FROM x_tasks WHERE cache_text IS NULL "
                            "GROUP BY project", **PLAN_VIEWS)
def estimate_requests(lake):
    return planning.estimate_requests(tasks_of(lake))


@query("platform_writes", """
  SELECT p.project, p.platform, k.n * (l.n + 1) AS platform_writes FROM v_platforms p
  JOIN (SELECT project, count(*) AS n FROM v_source GROUP BY 1) k USING (project)
  JOIN (SELECT project, count(*) AS n FROM v_targets GROUP BY 1) l USING (project)""")
def platform_writes(lake):
    return planning.platform_writes(lake.source, lake.locales, lake.platforms)


@query("status_summary", """
  SELECT t.project, missing, stale_retranslations, reviewed_stale, removed, cache_hits, pending,
    completed_translations, total_translations,
    CASE WHEN total_translations IS NULL THEN NULL WHEN total_translations = 0 THEN 100.0
         ELSE least(100.0, round(completed_translations / total_translations * 100, 1)) END::DOUBLE AS percent_complete,
    CASE WHEN total_translations IS NOT NULL THEN greatest(0, total_translations - completed_translations) END AS remaining,
    coalesce(status, 'idle') AS sync_state, pending - cache_hits AS provider_requests
  FROM x_totals t LEFT JOIN v_state USING (project)""", **PLAN_VIEWS)
def status_summary(lake):
    return audit_plan.status_report(lake.catalog)


@query("task_sequence", """
  SELECT project, locale, key, row_number() OVER (PARTITION BY project ORDER BY locale, key) AS position,
    count(*) OVER (PARTITION BY project) AS total FROM x_tasks""", **PLAN_VIEWS)
def task_sequence(lake):
    return ranking.task_sequence(tasks_of(lake).select("project", "locale", "key"))


REQUESTS = f"""
  SELECT t.project, t.locale, t.key, s.text AS source_text, s.description,
    list_transform({used_placeholders('s.text', 's.ph')}, lambda p: p.n || ':' || p.t) AS ph, g.terms
  FROM x_tasks t JOIN v_source s ON s.project = t.project AND s.key = t.key
  LEFT JOIN (SELECT project, locale, list(source_term || ' => ' || target_term ORDER BY source_term) AS terms
             FROM v_glossary GROUP BY ALL) g ON g.project = t.project AND g.locale = t.locale"""


def _requests(lake):
    return planning.translation_requests(tasks_of(lake), lake.source, lake.glossary)


@query("translation_requests", """
  SELECT project, locale, key, 'en' AS source_locale, source_text, description,
    array_to_string(ph, ',') AS placeholders, coalesce(array_to_string(terms, ','), '') AS glossary FROM x_requests""",
       **PLAN_VIEWS, x_requests=REQUESTS)
def translation_requests(lake):
    return _requests(lake).select(
        "project", "locale", "key", "source_locale", "source_text", "description",
        F.array_join(F.transform("placeholders", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("placeholders"),
        F.array_join(F.transform("glossary", lambda g: F.concat(g["source"], F.lit(" => "), g["target"])), ",").alias("glossary"))


@query("prompt_text", r"""
  SELECT project, locale, key, concat_ws(chr(10) || chr(10),
    'You translate short texts of an app''s screens.', 'From: en', 'Into: ' || locale,
    'Answer with one JSON object whose "text" member is the translation.',
    'Keep every placeholder letter for letter and as often as it occurs.',
    'Write no notes of your own and make up no placeholders.',
    'Placeholders: ' || CASE WHEN len(ph) > 0 THEN array_to_string(ph, ', ') ELSE 'none' END,
    CASE WHEN len(description) > 0 THEN 'Used for: ' || description END,
    CASE WHEN len(terms) > 0 THEN 'Terms:' || chr(10)
      || array_to_string(list_transform(terms, lambda t: '- ' || t), chr(10)) END,
    'Text:' || chr(10) || source_text) AS prompt FROM x_requests""", **PLAN_VIEWS, x_requests=REQUESTS)
def prompt_text(lake):
    return planning.prompt_text(_requests(lake)).select("project", "locale", "key", "prompt")


# --- rows ------------------------------------------------------------------------------------
@query("latest_entry", """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY project, locale, pk, orphan
      ORDER BY "at" DESC, ok DESC, ln DESC, sk DESC, price DESC, flag DESC, status DESC) AS rn
    FROM (SELECT (l_suppkey % 4)::INTEGER AS project,
      ['de', 'es', 'fr', 'pt-BR', 'zh-Hans', 'fil', 'es-419'][(l_linenumber % 7 + 1)::INTEGER] AS locale,
      l_partkey AS pk, l_orderkey % 31 = 0 AS orphan, l_shipdate AS "at", l_orderkey AS ok, l_linenumber AS ln,
      l_suppkey AS sk, l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status FROM lineitem)) WHERE rn = 1""")
def latest_entry(lake):
    return rows.latest_entry(lake.versions, ["project", "locale", "pk", "orphan"],
                             ["at", "ok", "ln", "sk", "price", "flag", "status"])


SEEN = "SELECT DISTINCT project, locale, false AS is_source FROM v_entries"


@query("select_locales", """
  SELECT project, locale, 'selected' AS outcome FROM x_seen WHERE locale IN ('de', 'fil')
  UNION ALL SELECT DISTINCT project, 'xx', 'L10N_E0069' FROM x_seen""", x_seen=SEEN)
def select_locales(lake):
    seen = lake.entries.select("project", "locale").distinct().withColumn("is_source", F.lit(False))
    chosen, unknown = rows.select_locales(seen, ["fil", "de", "xx", "de"])
    return chosen.withColumn("outcome", F.lit("selected")).unionByName(
        unknown.select("project", "locale", F.col("code").alias("outcome")))


@query("check_stale", f"""
  SELECT project, 'L10N_E0064' AS code, 'error' AS level, locale, key,
    'actual_source_hash=' || source_hash || ';expected_source_hash=' || expected AS details
  FROM x_joined WHERE NOT {blank('text')} AND source_hash <> expected""", x_joined=JOINED)
def check_stale(lake):
    return flat(audit.check_stale(lake.source, lake.entries))


@query("refresh_stale_flags", """
  SELECT e.project, e.locale, e.key, reviewed,
    CASE WHEN s.key IS NULL THEN stale WHEN reviewed AND e.source_hash <> s.source_hash THEN true
         WHEN e.source_hash = s.source_hash THEN false ELSE stale END AS stale,
    coalesce((reviewed AND e.source_hash <> s.source_hash AND NOT stale) OR (e.source_hash = s.source_hash AND stale),
      false) AS changed
  FROM v_entries e LEFT JOIN v_source s ON s.project = e.project AND s.key = e.key""")
def refresh_stale_flags(lake):
    return rows.refresh_stale_flags(lake.entries, lake.source).select(
        "project", "locale", "key", "reviewed", "stale", "changed")


@query("live_entries", """
  SELECT project, locale, key, text, (project, locale) IN (SELECT (project, locale) FROM x_gone) AS dirty
  FROM v_entries e SEMI JOIN v_source s ON s.project = e.project AND s.key = e.key""", x_gone=GONE)
def live_entries(lake):
    dirty = rows.dirty_locales(lake.entries, lake.source).withColumn("dirty", F.lit(True))
    return rows.live_entries(lake.entries, lake.source).join(dirty, ["project", "locale"], "left").select(
        "project", "locale", "key", "text", F.coalesce("dirty", F.lit(False)).alias("dirty"))


@query("removed_entries", "SELECT project, locale, count(*) AS removed FROM x_gone GROUP BY ALL", x_gone=GONE)
def removed_entries(lake):
    return rows.removed_entries(lake.entries, lake.source).groupBy("project", "locale").agg(
        F.count(F.lit(1)).alias("removed"))


@query("validate_rows", r"""
  SELECT failed, count(*) AS n FROM (
    SELECT concat_ws(',',
      CASE WHEN NOT regexp_full_match(c_locale, '[a-z]{2,3}(-[A-Za-z]{4})?(-([A-Z]{2}|\d{3}))?') THEN 'locale' END,
      CASE WHEN NOT regexp_full_match(c_hash, 'sha256:[0-9a-f]{64}') THEN 'source_hash' END,
      CASE WHEN NOT regexp_full_match(c_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z') THEN 'translated_at' END,
      CASE WHEN c_text IS NULL THEN 'text' END) AS failed
    FROM (SELECT CASE WHEN pk % 7 = 0 THEN upper(locale) ELSE locale END AS c_locale,
        CASE WHEN pk % 5 = 0 THEN replace(source_hash, 'sha256:', '') ELSE source_hash END AS c_hash,
        strftime(translated_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN pk % 3 = 0 THEN '' ELSE 'Z' END AS c_at,
        CASE WHEN pk % 11 <> 0 THEN text END AS c_text FROM v_entries)) GROUP BY 1""")
def validate_rows(lake):
    pk = F.col("pk")
    dressed = lake.entries.select(
        "project",
        F.when(pk % 7 == 0, F.upper("locale")).otherwise(F.col("locale")).alias("locale"),
        F.when(pk % 5 == 0, F.replace("source_hash", F.lit("sha256:"), F.lit(""))).otherwise(
            F.col("source_hash")).alias("source_hash"),
        F.concat(F.date_format("translated_at", "yyyy-MM-dd'T'HH:mm:ss"),
                 F.when(pk % 3 == 0, "").otherwise("Z")).alias("translated_at"),
        F.when(pk % 11 != 0, F.col("text")).alias("text"))
    good, bad = rows.validate_rows(dressed)
    return good.select(F.lit("").alias("failed")).unionByName(
        bad.select(F.array_join("failed", ",").alias("failed"))).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


# Snapshot paths by key arithmetic: some climb out of the root, one class only seems to.
PATHS = """
  SELECT project, locale, pk, text AS content, CASE WHEN pk % 6 = 0 THEN '../up/' || locale || '.json'
    WHEN pk % 6 = 1 THEN '/etc/' || locale WHEN pk % 6 = 2 THEN 'a/../b/' || locale
    WHEN pk % 6 = 3 THEN 'a/../../b' WHEN pk % 6 = 4 THEN './res/values/' || locale ELSE 'res/' || locale END AS path
  FROM v_entries"""


def _paths(lake):
    m, loc = F.col("pk") % 6, F.col("locale")
    path = (F.when(m == 0, F.concat(F.lit("../up/"), loc, F.lit(".json"))).when(m == 1, F.concat(F.lit("/etc/"), loc))
            .when(m == 2, F.concat(F.lit("a/../b/"), loc)).when(m == 3, F.lit("a/../../b"))
            .when(m == 4, F.concat(F.lit("./res/values/"), loc)).otherwise(F.concat(F.lit("res/"), loc)))
    return lake.entries.select("project", F.col("text").alias("content"), path.alias("path"), "pk")


@query("snapshot_path_guard", "SELECT project, path, count(*) AS n, pk % 6 IN (0, 1, 3) AS rejected FROM x_paths "
                              "GROUP BY ALL", x_paths=PATHS)
def snapshot_path_guard(lake):
    good, bad = rows.snapshot_path_guard(_paths(lake))
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).groupBy(
        "project", "path", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query("resume_state_filter", """
  SELECT project, config_hash = 'c1' AND source_hash = 's' || (project % 2) AS kept, count(*) AS n
  FROM v_states WHERE event_id % 5 <> 0 GROUP BY ALL
  UNION ALL SELECT project, false, count(*) FROM v_states WHERE event_id % 5 = 0 GROUP BY ALL""")
def resume_state_filter(lake):
    legacy = F.col("event_id") % 5 == 0
    states = lake.states.withColumn("config_hash", F.when(~legacy, F.col("config_hash")))
    fingerprints = lake.states.select(
        "project", F.lit("c1").alias("config_hash"),
        F.concat(F.lit("s"), (F.col("project") % 2).cast("string")).alias("source_hash")).distinct()
    kept, dropped = rows.resume_state_filter(states, fingerprints)
    bad_legacy = states.filter(legacy).groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "kept", F.lit(False))
    counted = kept.select("project", F.lit(True).alias("kept")).unionByName(
        dropped.select("project", F.lit(False).alias("kept"))).groupBy("project", "kept").agg(
        F.count(F.lit(1)).alias("n"))
    # Legacy rows are among the dropped; report them as a class of their own.
    return counted.join(bad_legacy.withColumnRenamed("n", "_legacy"), ["project", "kept"], "left").select(
        "project", "kept", (F.col("n") - F.coalesce("_legacy", F.lit(0))).alias("n")).filter("n > 0").unionByName(
        bad_legacy.select("project", "kept", "n"))


@query("history_stats", """
  SELECT project, count(*) AS entries, arg_max(ts, line_no) AS last_at FROM v_history GROUP BY project""")
def history_stats(lake):
    return rows.history_stats(lake.history)


@query("locale_delta", """
  SELECT project, locale, 'added' AS change FROM v_targets t
    WHERE NOT EXISTS (FROM v_entries e WHERE e.project = t.project AND e.locale = t.locale)
  UNION ALL SELECT DISTINCT project, locale, 'removed' FROM v_entries e
    WHERE NOT EXISTS (FROM v_locales l WHERE e.project = l.project AND e.locale = l.locale)""")
def locale_delta(lake):
    return rows.locale_delta(lake.entries, lake.locales)


@query("rules_validate", """
  SELECT s_suppkey::INT AS project, 'L10N_E0003' AS code, unnest(list_filter([
      CASE WHEN s_suppkey % 7 = 0 THEN 'key_case' END, CASE WHEN s_suppkey % 11 > 9 THEN 'max_depth' END,
      CASE WHEN s_suppkey % 5 = 0 THEN 'source_locale' END,
      CASE WHEN (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0) OR (s_suppkey % 3 <> 0 AND s_suppkey % 13 = 0) THEN 'target_locales' END,
      CASE WHEN s_suppkey % 17 = 0 THEN 'platforms' END], lambda f: f IS NOT NULL)) AS field FROM supplier
  UNION ALL SELECT s_suppkey::INT, 'ok', 'glossary:2' FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <= 9
    AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0""")
def rules_validate(lake):
    k = F.col("s_suppkey")
    config = lake.table("supplier").select(
        k.cast("int").alias("project"),
        F.when(k % 5 == 0, "english").otherwise("en").alias("source_locale"),
        F.when(k % 3 == 0, F.array(F.lit("en"), F.lit("de"))).when(
            k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("de"), F.lit("pt-BR"))).alias("target_locales"),
        F.when(k % 7 == 0, "camel").otherwise("snake").alias("key_case"),
        F.when(k % 11 > 9, 11).otherwise((k % 11).cast("int") + 1).alias("max_depth"),
        F.lit(None).cast("array<string>").alias("scopes"), F.lit(None).cast("array<string>").alias("forbidden_prefixes"),
        F.when(k % 17 != 0, F.create_map(F.lit("ios"), F.struct(
            F.lit("a.strings").alias("path"), F.lit(None).cast("string").alias("key_transform")))).alias("platforms"),
        F.create_map(F.lit("ring"), F.create_map(F.lit("de"), F.lit("Ring"), F.lit("pt-BR"), F.lit("anel"))).alias("glossary"),
        F.lit("local").alias("provider_type"), F.lit(None).cast("string").alias("model"))
    assert [c.split()[0] for c in CONFIG.split(", ")][:2] == config.columns[:2]
    rules, locales, platforms, glossary, bad = project_rules(config)
    fine = rules.select("project").join(platforms.select("project"), "project").join(
        glossary.groupBy("project").agg(F.count(F.lit(1)).alias("n")), "project").select(
        "project", F.lit("ok").alias("code"), F.concat(F.lit("glossary:"), F.col("n").cast("string")).alias("field"))
    return bad.select("project", "code", F.col("details")["field"].alias("field")).unionByName(fine)


# --- audit -----------------------------------------------------------------------------------
LINT = r"""
  SELECT project, key, f.c AS code, 'error' AS level, f.d AS details FROM (
    SELECT project, key, unnest([
      CASE WHEN NOT ok_case THEN {'c': 'L10N_E0020', 'd': 'expected=' || key_case} END,
      CASE WHEN len(seg) > max_depth THEN {'c': 'L10N_E0021', 'd': 'actual_depth=' || len(seg) || ';max_depth=' || max_depth} END,
      CASE WHEN len(scopes) > 0 AND seg[1] <> '' AND NOT list_contains(scopes, seg[1])
           THEN {'c': 'L10N_E0022', 'd': 'scope=' || seg[1] || ';scopes=' || array_to_string(scopes, ', ')} END,
      CASE WHEN prefix IS NOT NULL THEN {'c': 'L10N_E0023', 'd': 'prefix=' || prefix} END,
      CASE WHEN regexp_matches(text, '\{\s*[\w.-]+\s*,\s*plural\s*,') THEN {'c': 'L10N_E0042', 'd': ''} END]) AS f
    FROM (SELECT s.project, s.key, s.text, r.* EXCLUDE (project),
        string_split(s.key, CASE key_case WHEN 'dotted.lower' THEN '.' WHEN 'kebab' THEN '-' ELSE '_' END) AS seg,
        regexp_full_match(s.key, CASE key_case WHEN 'dotted.lower' THEN '[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)*'
          WHEN 'kebab' THEN '[a-z][a-z0-9]*(-[a-z0-9]+)*' ELSE '[a-z][a-z0-9]*(_[a-z0-9]+)*' END) AS ok_case,
        list_filter(forbidden_prefixes, lambda p: starts_with(s.key, p))[1] AS prefix
      FROM v_source s JOIN v_rules r ON r.project = s.project)) WHERE f IS NOT NULL"""


@query("lint_keys", "SELECT project, code, level, key, details FROM x_lint", x_lint=LINT)
def lint_keys(lake):
    return flat(linting.lint_keys(lake.source, lake.rules), "project", "code", "level", "key")


@query("lint_renameable", "SELECT project, code, key FROM x_lint WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023'",
       x_lint=LINT)
def lint_renameable(lake):
    return linting.renameable(linting.lint_keys(lake.source, lake.rules)).select("project", "code", "key")


@query("rename_candidates", """
  SELECT l.project, l.key, any_value(s.text) AS text, any_value(s.description) AS description,
    string_agg(DISTINCT code, ',' ORDER BY code) AS violations
  FROM x_lint l JOIN v_source s ON s.project = l.project AND s.key = l.key
  WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023' GROUP BY ALL""", x_lint=LINT)
def rename_candidates(lake):
    found = linting.lint_keys(lake.source, lake.rules)
    return linting.rename_candidates(found, lake.source).withColumn("violations", F.array_join("violations", ","))


MISSING = f"""
  SELECT t.project, 'L10N_E0063' AS code, t.locale, s.key FROM v_source s JOIN v_targets t ON t.project = s.project
    WHERE EXISTS (FROM v_entries e WHERE e.project = t.project AND e.locale = t.locale)
      AND NOT EXISTS (FROM v_entries e WHERE e.project = t.project AND e.locale = t.locale AND e.key = s.key
                      AND NOT {blank('e.text')})
  UNION ALL SELECT project, 'L10N_E0061', locale, NULL FROM v_targets t
    WHERE NOT EXISTS (FROM v_entries e WHERE e.project = t.project AND e.locale = t.locale)"""


@query("check_missing", "SELECT * FROM x_missing", x_missing=MISSING)
def check_missing(lake):
    return audit.check_missing(lake.source, lake.entries, lake.locales).select("project", "code", "locale", "key")


@query("check_orphans", "SELECT project, 'L10N_E0065' AS code, locale, key FROM x_gone", x_gone=GONE)
def check_orphans(lake):
    return audit.check_orphans(lake.entries, lake.source).select("project", "code", "locale", "key")


@query("check_placeholders", f"""
  SELECT project, 'L10N_E0041' AS code, locale, key FROM x_joined
  WHERE NOT {blank('text')} AND NOT {parity('source_text', 'text')}""", x_joined=JOINED)
def check_placeholders(lake):
    return audit.check_placeholders(lake.source, lake.entries).select("project", "code", "locale", "key")


@query("sync_gate", f"""
  SELECT project, code, CASE WHEN code = 'L10N_E0090' THEN 'warn' ELSE 'error' END AS level, locale, key FROM (
    SELECT project, locale, key, CASE
      WHEN source_hash = expected AND NOT {blank('text')} AND NOT {parity('source_text', 'text')} THEN 'L10N_E0041'
      WHEN source_hash <> expected AND reviewed AND {parity('source_text', 'text')} THEN 'L10N_E0090'
      WHEN source_hash <> expected AND reviewed THEN 'L10N_E0082' END AS code FROM x_joined) WHERE code IS NOT NULL""",
       x_joined=JOINED)
def sync_gate(lake):
    return audit.sync_gate(lake.entries, lake.source).select("project", "code", "level", "locale", "key")


def _term(text, term):
    quoted = rf"regexp_replace({term}, '([^\w\s])', '\\\1', 'g')"
    # The containment test first: a pattern per row is costly to compile.
    return (rf"CASE WHEN trim({term}) = '' THEN true WHEN NOT contains({text}, {term}) THEN false "
            rf"ELSE regexp_matches({text}, '(^|[^\p{{L}}])' || {quoted} || '($|[^\p{{L}}])') END")


@query("lint_glossary", f"""
  SELECT s.project, 'L10N_E0087' AS code, 'error' AS level, e.locale, s.key,
    'expected_term=' || target_term || ';source_term=' || source_term AS details
  FROM v_source s JOIN v_glossary g ON g.project = s.project AND {_term('s.text', 'source_term')}
  JOIN v_entries e ON e.project = s.project AND e.locale = g.locale AND e.key = s.key
  WHERE NOT {blank('e.text')} AND NOT {_term('e.text', 'target_term')}""")
def lint_glossary(lake):
    return flat(linting.lint_glossary(lake.source, lake.entries, lake.glossary))


@query("lint_catalog", f"""
  SELECT project, findings, findings = 0 AS lint_ok, findings = 0 AS check_ok FROM (
    SELECT p.project, coalesce(l.n, 0)::BIGINT + coalesce(g.n, 0)::BIGINT AS findings
    FROM (SELECT DISTINCT project FROM v_source) p
    LEFT JOIN (SELECT project, count(*) AS n FROM x_lint GROUP BY 1) l USING (project)
    LEFT JOIN (SELECT s.project, count(*) AS n FROM v_source s
      JOIN v_glossary g ON g.project = s.project AND {_term('s.text', 'source_term')}
      JOIN v_entries e ON e.project = s.project AND e.locale = g.locale AND e.key = s.key
      WHERE NOT {blank('e.text')} AND NOT {_term('e.text', 'target_term')} GROUP BY 1) g USING (project))""", x_lint=LINT)
def lint_catalog(lake):
    return audit_plan.lint_verdict(audit_plan.lint_catalog(lake.catalog, glossary=True), lake.source)


EXPECTED = f"""
  SELECT b.*, p.platform FROM (
    SELECT project, 'en' AS locale, key, text, {signature('text', 'ph')} AS sig FROM v_source
    UNION ALL
    SELECT e.project, e.locale, e.key, e.text, {signature('e.text', 'coalesce(s.ph, [])')}
    FROM v_entries e SEMI JOIN v_targets USING (project, locale)
    LEFT JOIN v_source s ON s.project = e.project AND s.key = e.key) b JOIN v_platforms p USING (project)"""
DRIFT = """
  SELECT project, platform, locale, key, code FROM (
    SELECT project, platform, locale, key, unnest([
      CASE WHEN a.text IS NULL THEN 'L10N_E0066' END, CASE WHEN a.text <> e.text THEN 'L10N_E0067' END,
      CASE WHEN a.sig <> e.sig THEN 'L10N_E0041' END, CASE WHEN e.text IS NULL THEN 'L10N_E0068' END]) AS code
    FROM x_expected e FULL JOIN v_platform a USING (project, platform, locale, key)) WHERE code IS NOT NULL"""


@query("platform_drift", "SELECT project, code, 'platform=' || platform AS details, locale, key FROM x_drift",
       x_expected=EXPECTED, x_drift=DRIFT)
def platform_drift(lake):
    entries = audit.configured(lake.entries, lake.locales)
    expected = audit.expected_platform(lake.source, entries, lake.platforms)
    return flat(audit.platform_drift(expected, lake.platform_entries), "project", "code", "locale", "key")


AUDIT = f"""
  SELECT project, code, locale, key FROM (
    SELECT project, code, NULL AS locale, key FROM x_lint
    UNION ALL SELECT project, code, locale, key FROM x_missing
    UNION ALL SELECT project, 'L10N_E0064', locale, key FROM x_joined SEMI JOIN v_targets USING (project, locale)
      WHERE NOT {blank('text')} AND source_hash <> expected
    UNION ALL SELECT project, 'L10N_E0041', locale, key FROM x_joined SEMI JOIN v_targets USING (project, locale)
      WHERE NOT {blank('text')} AND NOT {parity('source_text', 'text')}
    UNION ALL SELECT project, 'L10N_E0065', locale, key FROM x_gone SEMI JOIN v_targets USING (project, locale)
    UNION ALL SELECT project, code, locale, key FROM x_drift)"""
AUDIT_VIEWS = {"x_lint": LINT, "x_missing": MISSING, "x_joined": JOINED, "x_gone": GONE, "x_expected": EXPECTED,
               "x_drift": DRIFT, "x_audit": AUDIT}


@query("audit_catalog", "SELECT project, code, 'error' AS level, locale, key FROM x_audit", **AUDIT_VIEWS)
def audit_catalog(lake):
    return audit_plan.audit_catalog(lake.catalog).select("project", "code", "level", "locale", "key")


@query("check_summary", "SELECT project, code, 'error' AS level, count(*) AS n FROM x_audit GROUP BY ALL", **AUDIT_VIEWS)
def check_summary_query(lake):
    return check_summary(audit_plan.audit_catalog(lake.catalog))


@query("error_gate", f"""
  SELECT project, NOT bool_or(bad) AS ok FROM (
    SELECT project * 10 + CASE locale WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS project,
      pk % 1999 = 7 AND locale = 'fr' AS bad FROM v_entries) GROUP BY project""")
def error_gate(lake):
    scope = F.col("project") * 10 + F.when(F.col("locale") == "de", 1).when(F.col("locale") == "fr", 2).otherwise(3)
    bad = (F.col("pk") % 1999 == 7) & (F.col("locale") == "fr")
    return has_errors(lake.entries.select(
        scope.alias("project"), F.when(bad, "error").otherwise("warn").alias("level")))


@query("canonical_entries", f"""
  SELECT e.project, e.locale, e.key, array_to_string(list_transform(
    {used_placeholders('e.text', 'coalesce(s.ph, [])')}, lambda p: p.n || ':' || p.t), '|') AS placeholders
  FROM v_entries e LEFT JOIN v_source s ON s.project = e.project AND s.key = e.key""")
def canonical_entries(lake):
    return audit.canonical_entries(lake.entries, lake.source).select(
        "project", "locale", "key", F.array_join(F.transform(
            "placeholders", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|").alias("placeholders"))


# --- coverage --------------------------------------------------------------------------------
@query("locale_coverage", """
  SELECT t.project, t.locale, coalesce(c.total_entries, 0) AS total_entries, coalesce(c.reviewed, 0) AS reviewed,
    coalesce(c.machine_translated, 0) AS machine_translated, coalesce(c.stale, 0) AS stale,
    coalesce(c.orphaned, 0) AS orphaned, k.n - coalesce(c.reviewed + c.machine_translated, 0) AS missing
  FROM v_targets t JOIN (SELECT project, count(*) AS n FROM v_source GROUP BY 1) k USING (project)
  LEFT JOIN (SELECT e.project, e.locale, count(*) AS total_entries,
      count(*) FILTER (s.key IS NOT NULL AND reviewed) AS reviewed,
      count(*) FILTER (s.key IS NOT NULL AND NOT reviewed) AS machine_translated,
      count(*) FILTER (e.source_hash <> s.source_hash) AS stale, count(*) FILTER (s.key IS NULL) AS orphaned
    FROM v_entries e LEFT JOIN v_source s ON s.project = e.project AND s.key = e.key GROUP BY ALL) c
  ON c.project = t.project AND c.locale = t.locale""")
def locale_coverage(lake):
    return coverage.locale_coverage(lake.source, lake.entries, lake.locales)


@query("platform_inventory", """
  SELECT project, platform, count(DISTINCT key) FILTER (locale = 'en') AS key_count,
    string_agg(DISTINCT locale, ',' ORDER BY locale) AS locales FROM v_platform GROUP BY ALL""")
def platform_inventory(lake):
    return coverage.platform_inventory(lake.platform_entries, lake.locales).withColumn(
        "locales", F.array_join("locales", ","))


# --- cache -----------------------------------------------------------------------------------
CACHE_COLUMNS = "project, source_hash, locale, config_hash, model_version, text, cached_at"


@query("gc_cache", f"""
  SELECT {CACHE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY project, source_hash, locale, config_hash
      ORDER BY cached_at DESC, model_version DESC, text DESC) AS rn
    FROM v_cache SEMI JOIN v_source USING (project, source_hash)) WHERE rn <= 2""")
def gc_cache(lake):
    return cache.gc_cache(lake.cache, lake.source)


FRESH = """
  SELECT project, source_hash, locale, config_hash, model_version, any_value(text) || '!' AS text, max(cached_at) AS cached_at
  FROM v_cache WHERE model_version = 'm1' AND locale = 'de' GROUP BY ALL"""


@query("upsert_cache", f"""
  SELECT {CACHE_COLUMNS} FROM v_cache c ANTI JOIN x_fresh f
    USING (project, source_hash, locale, config_hash, model_version)
  UNION ALL SELECT {CACHE_COLUMNS} FROM x_fresh""", x_fresh=FRESH)
def upsert_cache(lake):
    key = ["project", "source_hash", "locale", "config_hash", "model_version"]
    fresh = lake.cache.filter("model_version = 'm1' AND locale = 'de'").groupBy(*key).agg(
        F.concat(F.min("text"), F.lit("!")).alias("text"), F.max("cached_at").alias("cached_at"))
    return cache.upsert_cache(lake.cache, fresh)


@query("cache_sorted", f"SELECT {CACHE_COLUMNS} FROM v_cache ORDER BY ALL")
def cache_sorted(lake):
    from lexilake.sinks.catalogs import cache_sorted as sorted_rows

    return sorted_rows(lake.cache)


# --- expressions -----------------------------------------------------------------------------
@query("extract_placeholders", f"""
  SELECT project, locale, key, array_to_string({names('text')}, ',') AS names FROM v_entries""")
def extract_placeholders_query(lake):
    return lake.entries.select("project", "locale", "key", F.array_join(
        extract_placeholders(F.col("text")), ",").alias("names"))


@query("placeholder_parity", f"""
  SELECT project, count(*) AS pairs, count(*) FILTER ({parity('source_text', 'text')}) AS in_parity
  FROM x_joined WHERE NOT {blank('text')} GROUP BY project""", x_joined=JOINED)
def placeholder_parity(lake):
    from lexilake.functions.text import is_blank

    s = lake.source.select("project", "key", F.col("text").alias("source_text"))
    return lake.entries.join(shuffled(s), ["project", "key"]).filter(~is_blank(F.col("text"))).groupBy("project").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(has_parity(F.col("source_text"), F.col("text"))).alias("in_parity"))
