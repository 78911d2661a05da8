"""Applying, importing, archiving, renaming, duplicates, merging, restoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.queries_core import GONE, LINT, PLAN_VIEWS, plan_of, tasks_of
from contract.registry import flat, query
from contract.views import Lake, blank, parity
from lexilake.functions.hashing import source_hash
from lexilake.functions.text import extract_placeholders
from lexilake.operators import applying, audit, coverage, dedupe, linting, merging, near, ranking, renaming, restoring
from lexilake.plans import review, sync as sync_plan
from lexilake.providers import plan_renames, plan_renames_with, translate_with
from lexilake.session import durable, shuffled
from lexilake.sinks.archive import name_archives

NOW = "timestamp_ntz'2024-05-01 12:34:56'"


def now():
    return F.expr(NOW)


# --- applying --------------------------------------------------------------------------------
# Recorded responses: one per distinct request, some failing, some losing a placeholder, some absent.
RESPONSES = """
  SELECT 'en' AS source_locale, locale, source_text, 0::BIGINT AS response_no,
    CASE WHEN m = 1 THEN replace(source_text, '{name}', '') ELSE '[' || locale || '] ' || source_text END AS text,
    CASE WHEN m = 2 THEN 'L10N_E0053' END AS error_code
  FROM (SELECT locale, source_text, length(source_text || locale) % 7 AS m FROM (
    SELECT DISTINCT t.locale, s.text AS source_text FROM x_tasks t JOIN v_source s
      ON s.project = t.project AND s.key = t.key WHERE t.cache_text IS NULL)) WHERE m <> 3"""


def responses_of(lake, tasks):
    m = F.length(F.concat("source_text", "locale")) % 7
    asked = tasks.filter(F.col("cache_text").isNull()).join(
        shuffled(lake.source.select("project", "key", F.col("text").alias("source_text"))), ["project", "key"]).select(
        "locale", "source_text").distinct().filter(m != 3)
    return asked.select(
        F.lit("en").alias("source_locale"), "locale", "source_text", F.lit(0).cast("bigint").alias("response_no"),
        F.when(m == 1, F.replace("source_text", F.lit("{name}"), F.lit(""))).otherwise(
            F.concat(F.lit("["), F.col("locale"), F.lit("] "), F.col("source_text"))).alias("text"),
        F.lit("r1").alias("model_version"), F.when(m == 2, "L10N_E0053").alias("error_code"))


OUTCOMES = f"""
  SELECT t.project, t.locale, t.key, t.source_hash, coalesce(t.cache_text, r.text) AS text, cache_model, cached_at,
    CASE WHEN t.cache_text IS NOT NULL THEN 'cached' WHEN r.error_code IS NOT NULL THEN 'failed'
         WHEN r.text IS NULL THEN 'unanswered' WHEN {parity('s.text', 'r.text')} THEN 'translated'
         ELSE 'mismatch' END AS outcome
  FROM x_tasks t JOIN v_source s ON s.project = t.project AND s.key = t.key
  LEFT JOIN x_responses r ON r.locale = t.locale AND r.source_text = s.text"""
APPLY_VIEWS = {**PLAN_VIEWS, "x_responses": RESPONSES, "x_outcomes": OUTCOMES}


def _applied(lake):
    tasks = tasks_of(lake)
    return applying.apply_responses(tasks, responses_of(lake, tasks), lake.source, lake.configs, "recorded", now())


@query("apply_responses", """
  SELECT 'entry' AS kind, project, locale, key, text,
    CASE outcome WHEN 'cached' THEN cache_model ELSE 'r1' END AS detail,
    CASE outcome WHEN 'cached' THEN cached_at ELSE TIMESTAMP '2024-05-01 12:34:56' END AS at
  FROM x_outcomes WHERE outcome IN ('cached', 'translated')
  UNION ALL SELECT 'finding', project, locale, key, NULL, CASE outcome WHEN 'mismatch' THEN 'L10N_E0041'
    WHEN 'failed' THEN 'L10N_E0053' ELSE 'L10N_E0081' END, NULL
  FROM x_outcomes WHERE outcome NOT IN ('cached', 'translated')
  UNION ALL SELECT 'cache', project, locale, NULL, max(text), source_hash, TIMESTAMP '2024-05-01 12:34:56'
  FROM x_outcomes WHERE outcome = 'translated' GROUP BY project, locale, source_hash""", **APPLY_VIEWS)
def apply_responses(lake):
    entries, cache_rows, findings = _applied(lake)
    return entries.select(
        F.lit("entry").alias("kind"), "project", "locale", "key", "text", F.col("model_version").alias("detail"),
        F.col("translated_at").alias("at")).unionByName(findings.select(
            F.lit("finding").alias("kind"), "project", "locale", "key", F.lit(None).cast("string").alias("text"),
            F.col("code").alias("detail"), F.lit(None).cast("timestamp_ntz").alias("at"))).unionByName(
        cache_rows.select(F.lit("cache").alias("kind"), "project", "locale", F.lit(None).cast("string").alias("key"),
                          "text", F.col("source_hash").alias("detail"), F.col("cached_at").alias("at")))


@query("sync_report", """
  SELECT t.project, n.n - t.cache_hits AS translated, t.cache_hits, t.pending - t.cache_hits AS provider_requests,
    t.reviewed_stale AS reviewed_skipped, t.removed, (n.n - t.cache_hits) || ' translations generated, '
      || t.cache_hits || ' cache hits, ' || t.reviewed_stale || ' reviewed skipped, ' || t.removed || ' removed' AS summary
  FROM x_totals t JOIN (SELECT project, count(*) AS n FROM x_outcomes WHERE outcome IN ('cached', 'translated')
    GROUP BY 1) n USING (project)""", **APPLY_VIEWS)
def sync_report(lake):
    return applying.sync_report(plan_of(lake), _applied(lake)[0])


# --- importing -------------------------------------------------------------------------------
IMPORTED = f"""
  SELECT p.project, p.locale, p.key, p.text, CASE WHEN {parity('s.text', 'p.text')} THEN 'entry' ELSE 'L10N_E0041' END AS kind
  FROM v_platform p SEMI JOIN v_targets USING (project, locale)
  JOIN (SELECT project, key, text FROM v_platform WHERE locale = 'en') s ON s.project = p.project AND s.key = p.key
  WHERE NOT {blank('p.text')}"""


@query("import_catalog", """
  SELECT kind, project, locale, key, text, kind = 'entry' AS reviewed FROM x_imported
  UNION ALL SELECT 'source', project, locale, key, text, false FROM v_platform WHERE locale = 'en'""", x_imported=IMPORTED)
def import_catalog(lake):
    source, entries, findings = applying.import_catalog(lake.platform_entries, lake.locales, "ios", now())
    texts = lake.platform_entries.select("project", "locale", "key", "text")
    reported = findings.filter("code = 'L10N_E0041'").select("project", "locale", "key", "code").join(
        shuffled(texts), ["project", "locale", "key"])
    return entries.select(F.lit("entry").alias("kind"), "project", "locale", "key", "text", "reviewed").unionByName(
        source.select(F.lit("source").alias("kind"), "project", "locale", "key", "text",
                      F.lit(False).alias("reviewed"))).unionByName(
        reported.select(F.col("code").alias("kind"), "project", "locale", "key", "text",
                        F.lit(False).alias("reviewed")))


@query("import_report", """
  SELECT t.project, t.locale, coalesce(i.n, 0) AS imported, k.n - coalesce(i.n, 0) AS missing FROM v_targets t
  JOIN (SELECT project, count(*) AS n FROM v_platform WHERE locale = 'en' GROUP BY 1) k USING (project)
  LEFT JOIN (SELECT project, locale, count(*) AS n FROM x_imported WHERE kind = 'entry' GROUP BY ALL) i
    ON i.project = t.project AND i.locale = t.locale""", x_imported=IMPORTED)
def import_report(lake):
    source, entries, _ = applying.import_catalog(lake.platform_entries, lake.locales, "ios", now())
    return coverage.import_report(source, entries, lake.locales)


# --- archives --------------------------------------------------------------------------------
@query("archive_orphan_reviewed", """
  SELECT g.project, g.locale, key, name || CASE WHEN attempt = 0 THEN '' ELSE '-' || attempt END AS archive_name FROM (
      SELECT * FROM x_gone WHERE reviewed) g
  JOIN (SELECT project, locale, locale || '-20240501123456' AS name,
      row_number() OVER (PARTITION BY locale ORDER BY project) - 1 + CASE WHEN locale = 'de' THEN 2 ELSE 0 END AS attempt
    FROM (SELECT DISTINCT project, locale FROM x_gone WHERE reviewed)) n
  ON n.project = g.project AND n.locale = g.locale""", x_gone=GONE)
def archive_orphan_reviewed(lake):
    orphans = audit.orphaned_reviewed(lake.entries, lake.source)
    taken = lake.spark.sql("SELECT 'de-20240501123456' AS name, explode(array(0L, 1L)) AS attempt")
    return name_archives(orphans, now(), taken).select("project", "locale", "key", "archive_name")


@query("unique_archive_name", """
  SELECT name, archive_key, name || CASE WHEN rn + coalesce(t.top, 0) = 0 THEN ''
      ELSE '-' || (rn + coalesce(t.top, 0)) END AS archive_name
  FROM (SELECT o_orderpriority AS name, o_orderkey AS archive_key,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS rn FROM orders WHERE o_orderstatus = 'F') w
  LEFT JOIN (SELECT o_orderpriority AS name, max(o_custkey % 50) + 1 AS top FROM orders
    WHERE o_orderstatus = 'P' AND o_orderpriority < '4' GROUP BY 1) t USING (name)""")
def unique_archive_name(lake):
    orders = lake.table("orders")
    wanted = orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("archive_key"))
    taken = orders.filter("o_orderstatus = 'P' and o_orderpriority < '4'").select(
        F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 50).alias("attempt"))
    return ranking.unique_archive_name(wanted, taken).select("name", "archive_key", "archive_name")


# --- renaming --------------------------------------------------------------------------------
# A plan by key arithmetic that breaks every rule somewhere.
RENAME_PLAN = """
  SELECT project, key AS from_key, to_key FROM (
    SELECT c.project, c.key, s.pk, CASE WHEN s.pk % 41 = 0 THEN NULL WHEN s.pk % 19 = 0 THEN c.key
      WHEN s.pk % 31 = 0 THEN 'economy.shared' WHEN s.pk % 43 = 0 THEN 'Bad Key' WHEN s.pk % 9 = 0 THEN 'ghost.k' || s.pk
      ELSE regexp_replace(lower(replace(replace(c.key, 'tmp.', ''), '.a.b.c', '')), '[^a-z0-9]+', '.', 'g') END AS to_key
    FROM (SELECT DISTINCT project, key FROM x_lint WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023') c
    JOIN v_source s ON s.project = c.project AND s.key = c.key)
  UNION ALL SELECT project, 'unknown.k' || pk, 'economy.fresh.k' || pk FROM v_source WHERE pk % 97 = 1"""


def _plan(lake):
    found = linting.lint_keys(lake.source, lake.rules)
    c = linting.rename_candidates(found, lake.source).select("project", "key", "violations")
    pk = F.col("pk")
    styled = F.regexp_replace(F.lower(F.replace(F.replace("key", F.lit("tmp."), F.lit("")), F.lit(".a.b.c"), F.lit(""))),
                              "[^a-z0-9]+", ".")
    to = (F.when(pk % 41 == 0, None).when(pk % 19 == 0, F.col("key")).when(pk % 31 == 0, "economy.shared")
          .when(pk % 43 == 0, "Bad Key").when(pk % 9 == 0, F.concat(F.lit("ghost.k"), pk.cast("string"))).otherwise(styled))
    plan = c.join(shuffled(lake.source.select("project", "key", "pk")), ["project", "key"]).select(
        "project", F.col("key").alias("from_key"), to.alias("to_key"))
    stray = lake.source.filter(pk % 97 == 1).select(
        "project", F.concat(F.lit("unknown.k"), pk.cast("string")).alias("from_key"),
        F.concat(F.lit("economy.fresh.k"), pk.cast("string")).alias("to_key"))
    plan = plan.unionByName(stray).withColumns({
        "rationale": F.lit(None).cast("string"), "skip_reason": F.lit(None).cast("string")})
    return c, plan


PLAN_CTES = {"x_lint": LINT, "x_rplan": RENAME_PLAN}
KEY_LINT = r"""
  SELECT DISTINCT project, key, unnest(list_filter([
      CASE WHEN NOT regexp_full_match(key, CASE key_case WHEN 'dotted.lower' THEN '[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)*'
        WHEN 'kebab' THEN '[a-z][a-z0-9]*(-[a-z0-9]+)*' ELSE '[a-z][a-z0-9]*(_[a-z0-9]+)*' END) THEN 'L10N_E0020' END,
      CASE WHEN len(seg) > max_depth THEN 'L10N_E0021' END,
      CASE WHEN len(scopes) > 0 AND seg[1] <> '' AND NOT list_contains(scopes, seg[1]) THEN 'L10N_E0022' END,
      CASE WHEN len(list_filter(forbidden_prefixes, lambda p: starts_with(key, p))) > 0 THEN 'L10N_E0023' END],
      lambda c: c IS NOT NULL)) AS violation
  FROM (SELECT d.project, d.key, r.* EXCLUDE (project),
      string_split(d.key, CASE key_case WHEN 'dotted.lower' THEN '.' WHEN 'kebab' THEN '-' ELSE '_' END) AS seg
    FROM (SELECT DISTINCT s.project, coalesce(p.to_key, s.key) AS key FROM v_source s
          LEFT JOIN x_renames p ON p.project = s.project AND p.from_key = s.key) d
    SEMI JOIN x_renames n ON n.project = d.project AND n.to_key = d.key
    JOIN v_rules r ON r.project = d.project)"""


@query("validate_renames", """
  SELECT project, 'L10N_E0072' AS code, from_key AS key, '' AS other FROM x_rplan
    WHERE to_key IS NULL AND from_key NOT LIKE 'unknown%'
  UNION ALL SELECT project, 'L10N_E0073', from_key, '' FROM x_renames r
    WHERE NOT EXISTS (FROM v_source s WHERE s.project = r.project AND s.key = r.from_key)
  UNION ALL SELECT project, 'L10N_E0074', from_key, '' FROM x_renames WHERE from_key = to_key
  UNION ALL SELECT project, 'L10N_E0075', to_key, from_key FROM x_renames r WHERE EXISTS (FROM v_source s
      WHERE s.project = r.project AND s.key = r.to_key AND NOT EXISTS (
        FROM x_renames q WHERE q.project = s.project AND q.from_key = s.key))
  UNION ALL SELECT project, 'L10N_E0076', to_key, from_key FROM (
      SELECT *, count(*) OVER (PARTITION BY project, to_key) AS n FROM x_renames) WHERE n > 1
  UNION ALL SELECT project, 'L10N_E0077', key, violation FROM x_keylint""", **PLAN_CTES,
       x_renames="SELECT * FROM x_rplan WHERE to_key IS NOT NULL", x_keylint=KEY_LINT)
def validate_renames(lake):
    candidates, plan = _plan(lake)
    d = F.col("details")
    return renaming.validate_renames(plan, lake.source, lake.rules, candidates).select(
        "project", "code", "key", F.coalesce(d["from"], d["violation"], F.lit("")).alias("other"))


@query("apply_renames", """
  SELECT e.project, e.locale, coalesce(p.to_key, e.key) AS key, e.text FROM v_entries e
  LEFT JOIN x_rplan p ON p.project = e.project AND p.from_key = e.key AND p.to_key IS NOT NULL""", **PLAN_CTES)
def apply_renames(lake):
    return renaming.apply_renames(lake.entries.select("project", "locale", "key", "text"), _plan(lake)[1])


@query("rename_key", """
  SELECT project, locale, CASE WHEN project = 1 AND key = k.f THEN 'renamed.key' ELSE e.key END AS key, text
  FROM v_entries e, (SELECT min(key) AS f FROM v_source WHERE pk % 5 = 1) k""")
def rename_key(lake):
    # The key to rename is the smallest of a class; it is joined in, not collected.
    first = lake.source.filter(F.col("pk") % 5 == 1).groupBy("project").agg(F.min("key").alias("from_key")).filter(
        "project = 1").select("project", "from_key", F.lit("renamed.key").alias("to_key"))
    return renaming.apply_renames(lake.entries.select("project", "locale", "key", "text"), first)


@query("batch_candidates", """
  SELECT project, key, (row_number() OVER (PARTITION BY project ORDER BY key) - 1) // 25 AS batch_id
  FROM (SELECT DISTINCT project, key FROM x_lint WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023')""", x_lint=LINT)
def batch_candidates(lake):
    found = linting.lint_keys(lake.source, lake.rules)
    return ranking.batch_candidates(linting.rename_candidates(found, lake.source)).select("project", "key", "batch_id")


# Code that mentions keys: one file per order, a line per item.
CORPUS = """
  SELECT (l_orderkey % 4)::INT AS project, 'src/o' || l_orderkey || '.ts' AS path,
    string_agg('t("' || key || '"); // ' || text, chr(10) ORDER BY l_partkey, l_linenumber, l_suppkey, l_shipdate) AS text
  FROM lineitem JOIN v_parts p ON p.pk = l_partkey GROUP BY l_orderkey"""


def corpus_of(lake):
    """An order has a handful of items, so a file gathers that many lines.  Stored, as files are."""
    items = lake.table("lineitem").join(shuffled(lake.parts.select("pk", "key", "text")), F.col("l_partkey") == F.col("pk"))
    line = F.concat(F.lit('t("'), F.col("key"), F.lit('"); // '), F.col("text"))
    files = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", line.alias("line")))).alias("lines"))
    return durable(files.select(
        (F.col("l_orderkey") % 4).cast("int").alias("project"),
        F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("path"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")))


# Bare keys are prefixes of longer ones, so longest-first order and substring matching both show.
REF_PLAN = r"""
  SELECT project::INT AS project, key AS from_key, regexp_replace(lower(replace(key, 'tmp.', '')), '\.a\.b\.c', '_deep') || '_v2' AS to_key
  FROM v_source WHERE pk % 37 = 0 OR pk % 17 = 0 OR pk % 23 = 0 OR pk < 4"""


def ref_plan(lake):
    pk = F.col("pk")
    return lake.source.filter((pk % 37 == 0) | (pk % 17 == 0) | (pk % 23 == 0) | (pk < 4)).select(
        "project", F.col("key").alias("from_key"), F.concat(
            F.regexp_replace(F.lower(F.replace("key", F.lit("tmp."), F.lit(""))), r"\.a\.b\.c", "_deep"),
            F.lit("_v2")).alias("to_key"))


# The same fold in SQL over each file's own candidate keys: mark longest first, then fill in.
REWRITTEN = """
  SELECT project, path, text AS before, list_reduce(list_prepend(list_reduce(list_prepend(text, hides),
      lambda acc, r: replace(acc, split_part(r, chr(1), 1), split_part(r, chr(1), 2))), shows),
      lambda acc, r: replace(acc, split_part(r, chr(1), 1), split_part(r, chr(1), 2))) AS text,
    list_reduce(list_prepend(text, hides),
      lambda acc, r: replace(acc, split_part(r, chr(1), 1), split_part(r, chr(1), 2))) AS hidden
  FROM (SELECT c.project, c.path, c.text,
      list(p.from_key || chr(1) || chr(2) || p.n || chr(3) ORDER BY length(p.from_key) DESC, p.from_key) AS hides,
      list(chr(2) || p.n || chr(3) || chr(1) || p.to_key) AS shows
    FROM v_corpus c JOIN (SELECT *, chr((57344 + row_number() OVER (PARTITION BY project ORDER BY from_key))::INT) AS n
      FROM v_refplan) p ON p.project = c.project AND contains(c.text, p.from_key) GROUP BY ALL)"""


@query("bulk_reference_rewrite", """
  SELECT project, path, text, (length(hidden) - length(replace(hidden, chr(2), '')))::BIGINT AS replacements
  FROM x_rewritten WHERE text <> before""", v_corpus=CORPUS, v_refplan=REF_PLAN, x_rewritten=REWRITTEN)
def bulk_reference_rewrite(lake):
    return renaming.bulk_reference_rewrite(corpus_of(lake), ref_plan(lake))


@query("rename_report", """
  SELECT t.project, t.n AS locales_touched, f.files AS reference_files, f.hits AS replacements
  FROM (SELECT e.project, count(DISTINCT locale) AS n FROM v_entries e SEMI JOIN v_refplan p
        ON p.project = e.project AND p.from_key = e.key GROUP BY 1) t
  JOIN (SELECT project, count(*) AS files, sum(length(hidden) - length(replace(hidden, chr(2), '')))::BIGINT AS hits
        FROM x_rewritten WHERE text <> before GROUP BY 1) f USING (project)""",
       v_corpus=CORPUS, v_refplan=REF_PLAN, x_rewritten=REWRITTEN)
def rename_report(lake):
    plan = ref_plan(lake)
    return renaming.rename_report(lake.entries, plan, renaming.bulk_reference_rewrite(corpus_of(lake), plan))


@query("plan_renames", """
  SELECT project, key AS from_key, upper(key) AS to_key, count(*) OVER (PARTITION BY project, b) AS batch_rows
  FROM (SELECT project, key, (row_number() OVER (PARTITION BY project ORDER BY key) - 1) // 25 AS b
    FROM (SELECT DISTINCT project, key FROM x_lint WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023'))""", x_lint=LINT)
def plan_renames_query(lake):
    def upper(batch):
        return [{"from": r["key"], "to": r["key"].upper(), "rationale": f" {len(batch)} "} for r in batch] + [
            {"from": "not.asked", "to": "x"}]

    found = linting.lint_keys(lake.source, lake.rules)
    batches = ranking.batch_candidates(linting.rename_candidates(found, lake.source))
    return plan_renames_with(batches, upper).select(
        "project", "from_key", "to_key", F.col("rationale").cast("bigint").alias("batch_rows"))


@query("plan_renames_default", r"""
  SELECT project, key AS from_key, CASE WHEN made NOT IN ('', key) THEN made END AS to_key, 'restyled' AS rationale,
    CASE WHEN made IN ('', key) THEN 'no other spelling' END AS skip_reason
  FROM (SELECT *, CASE key_case WHEN 'dotted.lower' THEN array_to_string(cut, '.') WHEN 'kebab' THEN array_to_string(cut, '-')
      ELSE array_to_string(cut, '_') END AS made
    FROM (SELECT *, CASE WHEN len(w) <= max_depth THEN w WHEN max_depth = 1 THEN [array_to_string(w, '')]
      ELSE list_append(w[1:max_depth - 1], w[-1]) END AS cut
    FROM (SELECT c.project, c.key, key_case, max_depth, list_filter(regexp_split_to_array(lower(
          substr(c.key, coalesce(length(list_filter(forbidden_prefixes, lambda p: p <> '' AND starts_with(c.key, p))[1]), 0) + 1)),
          '[^a-z0-9]+'), lambda x: x <> '') AS w
      FROM (SELECT DISTINCT project, key FROM x_lint WHERE code BETWEEN 'L10N_E0020' AND 'L10N_E0023') c JOIN v_rules r ON r.project = c.project)))""",
       x_lint=LINT)
def plan_renames_default(lake):
    found = linting.lint_keys(lake.source, lake.rules)
    return plan_renames(linting.rename_candidates(found, lake.source), lake.rules)


@query("translate_with", """
  SELECT t.project, t.locale, t.key, s.text AS source_text,
    CASE WHEN contains(s.text, 'plural') THEN NULL ELSE t.locale || ':' || s.text || '|' || coalesce(s.description, '-')
      || '|' || coalesce(g.n, 0) END AS text,
    CASE WHEN contains(s.text, 'plural') THEN 'L10N_E0054' END AS error_code
  FROM x_tasks t JOIN v_source s ON s.project = t.project AND s.key = t.key
  LEFT JOIN (SELECT project, locale, count(*) AS n FROM v_glossary WHERE target_term <> '' GROUP BY ALL) g
    ON g.project = t.project AND g.locale = t.locale
  WHERE t.cache_text IS NULL""", **PLAN_VIEWS)
def translate_with_query(lake):
    """The answer depends on all the provider is asked, so two descriptions or glossaries give two answers."""
    from lexilake.operators.planning import translation_requests, uncached_requests

    def fn(request):
        if "plural" in request["source_text"]:
            raise ValueError("no plurals")
        return (f"{request['locale']}:{request['source_text']}|{request['description'] or '-'}|"
                f"{len(request['glossary'])}"), "m"

    requests = translation_requests(uncached_requests(tasks_of(lake)), lake.source, lake.glossary)
    return translate_with(requests, fn).select("project", "locale", "key", "source_text", "text", "error_code")


# --- duplicates ------------------------------------------------------------------------------
def documents(lake):
    return lake.table("documents").select(
        F.lit(0).alias("project"), F.format_string("d%08d", "doc_id").alias("key"), "text")


EXACT = """
  SELECT 0 AS project, text_hash, key, min(key) OVER w AS canonical_key, count(*) OVER w AS n FROM (
    SELECT sha256(text) AS text_hash, printf('d%08d', doc_id) AS key FROM documents)
  WINDOW w AS (PARTITION BY text_hash) QUALIFY n > 1"""


@query("exact_duplicates", EXACT)
def exact_duplicates(lake):
    return dedupe.exact_duplicates(documents(lake))


# Suggested groups by arithmetic: pairs of parts with the same name, with strangers, repeats and bad confidences.
GROUPS = """
  SELECT s.project, s.pk * 10 + v AS group_id, s.key AS canonical_key,
    CASE v WHEN 0 THEN 'no.such.k' || s.pk ELSE t.key END AS duplicate_key,
    (s.pk % 30) / 20.0 AS confidence, s.pk, v
  FROM v_source s JOIN v_source t ON t.project = s.project AND t.pk = s.pk + 1
  CROSS JOIN (VALUES (0), (1), (2)) r(v) WHERE s.pk % 3 = 0"""
EXACT_KEYS = """
  SELECT project, key, text FROM (SELECT project, key, text, count(*) OVER (PARTITION BY project, text) AS n
    FROM v_source) WHERE n > 1"""
CLEANED = """
  SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY project, canonical_key, duplicate_key
      ORDER BY group_id DESC) AS rn FROM x_groups) g
  JOIN v_source s ON s.project = g.project AND s.key = g.duplicate_key
  LEFT JOIN x_exact a ON a.project = g.project AND a.key = g.canonical_key
  LEFT JOIN x_exact b ON b.project = g.project AND b.key = g.duplicate_key
  WHERE rn = 1 AND NOT coalesce(a.text = b.text, false)"""
GROUP_VIEWS = {"x_groups": GROUPS, "x_exact": EXACT_KEYS, "x_cleaned": CLEANED}


def _groups(lake):
    s = lake.source.filter(F.col("pk") % 3 == 0).select("project", "pk", F.col("key").alias("canonical_key"))
    t = lake.source.select("project", (F.col("pk") - 1).alias("pk"), F.col("key").alias("_next"))
    spread = s.join(shuffled(t), ["project", "pk"]).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return spread.select(
        "project", (F.col("pk") * 10 + F.col("v")).alias("group_id"), "canonical_key",
        F.when(F.col("v") == 0, F.concat(F.lit("no.such.k"), F.col("pk").cast("string"))).otherwise(
            F.col("_next")).alias("duplicate_key"),
        ((F.col("pk") % 30) / 20.0).alias("confidence"), F.lit(" same ").alias("rationale"), F.lit("m").alias("model_version"))


@query("normalize_dup_groups", """
  SELECT project, group_id, canonical_key, duplicate_key, least(1.0, confidence)::DOUBLE AS confidence,
    'same' AS rationale FROM x_cleaned""", **GROUP_VIEWS)
def normalize_dup_groups(lake):
    exact = dedupe.exact_duplicates(lake.source)
    return dedupe.normalize_dup_groups(_groups(lake), lake.source, exact).drop("model_version")


@query("dedupe_summary", """
  SELECT k.project, k.n AS source_keys, coalesce(e.groups, 0) AS exact_groups, coalesce(c.n, 0) AS semantic_groups,
    coalesce(e.keys, 0) + 2 * coalesce(c.n, 0) AS duplicate_keys
  FROM (SELECT project, count(*) AS n FROM v_source GROUP BY 1) k
  LEFT JOIN (SELECT project, count(DISTINCT text) AS groups, count(*) AS keys FROM x_exact GROUP BY 1) e USING (project)
  LEFT JOIN (SELECT project, count(*) AS n FROM x_cleaned GROUP BY 1) c USING (project)""", **GROUP_VIEWS)
def dedupe_summary(lake):
    exact = dedupe.exact_duplicates(lake.source)
    cleaned = dedupe.normalize_dup_groups(_groups(lake), lake.source, exact)
    return dedupe.dedupe_summary(exact, cleaned, lake.source)


NEAR = r"""
  WITH RECURSIVE docs AS (SELECT 0 AS project, printf('d%08d', doc_id) AS key, text FROM documents),
  firsts AS (SELECT project, text, min(key) AS key FROM docs GROUP BY 1, 2),
  words AS (SELECT project, key, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM firsts),
  sets AS (
    SELECT project, key, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM words),
  elements AS (SELECT project, key, len(s) AS n, unnest(s) AS e FROM sets),
  shared AS (
    SELECT a.project, a.key AS a, b.key AS b, count(*) AS c, max(a.n) + max(b.n) AS n
    FROM elements a JOIN elements b ON a.project = b.project AND a.e = b.e AND a.key <> b.key GROUP BY 1, 2, 3),
  links AS (SELECT project, a, b FROM shared WHERE 10 * c >= 7 * (n - c)),
  reach(project, a, b) AS (
    SELECT project, a, b FROM links UNION SELECT r.project, r.a, l.b FROM reach r JOIN links l ON r.project = l.project AND r.b = l.a),
  labels AS (SELECT project, a AS key, least(a, min(b)) AS root FROM reach GROUP BY 1, 2),
  confidence AS (
    SELECT l.project, root, min(coalesce(c / (n - c), 0)) AS confidence FROM labels l
    LEFT JOIN shared s ON s.project = l.project AND s.a = l.key AND s.b = l.root WHERE l.key <> root GROUP BY 1, 2)
  SELECT d.project, l.root AS canonical_key, d.key AS duplicate_key, confidence
  FROM labels l JOIN firsts f ON f.project = l.project AND f.key = l.key JOIN docs d ON d.project = f.project AND d.text = f.text
  JOIN confidence c ON c.project = l.project AND c.root = l.root WHERE d.key <> l.root"""


@query("near_duplicates", NEAR)
def near_duplicates(lake):
    return near.near_duplicates(documents(lake), threshold=0.7)


# --- merging ---------------------------------------------------------------------------------
# One catalog file per part: both sides add a key of their own; some edit the same leaf, some are
# broken, some have no markers.
def _files(lake):
    pk = F.col("pk")
    side = lambda name, text: F.concat(
        F.lit('    "'), F.lit(name), F.col("key"), F.lit('": {"text": "'), text, F.lit('"},\n'))
    common = F.concat(F.lit('    "common": {"text": "c", "n": ['), (pk % 5).cast("string"), F.lit("]}\n  }\n}\n"))
    same_left = F.when(pk % 4 == 0, side("same.", F.lit("L"))).otherwise("")
    same_right = F.when(pk % 4 == 0, side("same.", F.when(pk % 8 == 0, "R").otherwise("L"))).otherwise("")
    head = F.lit('{\n  "version": 1,\n  "keys": {\n')
    torn = F.concat(
        head, F.lit("<<<<<<< ours\n"), side("left.", F.col("description")), same_left, F.lit("=======\n"),
        side("right.", F.col("description")), same_right,
        F.when(pk % 9 == 0, "").otherwise(">>>>>>> theirs\n"), common,
        F.when(pk % 9 == 0, "<!-- >>>>>>> -->\n").otherwise(""), F.when(pk % 10 == 0, "oops").otherwise(""))
    plain = F.concat(head, common)
    return lake.parts.filter("description is not null").select(
        (pk % 4).cast("int").alias("project"), F.concat(F.lit("f"), pk.cast("string")).alias("path"),
        F.when(pk % 7 == 0, plain).otherwise(torn).alias("text"))


FILES = """
  SELECT (pk % 4)::INT AS project, 'f' || pk AS path, pk, key, description, pk % 7 <> 0 AS torn,
    pk % 7 <> 0 AND pk % 9 = 0 AS malformed, pk % 7 <> 0 AND pk % 9 <> 0 AND pk % 10 = 0 AS unparsable,
    pk % 7 <> 0 AND pk % 9 <> 0 AND pk % 10 <> 0 AND pk % 8 = 0 AS clash
  FROM v_parts WHERE description IS NOT NULL"""


@query("conflict_sections", """
  SELECT project, path, torn AS conflicted, malformed, CASE WHEN malformed THEN NULL WHEN NOT torn THEN head || tail
      ELSE head || '    "left.' || key || '": {"text": "' || description || '"},' || chr(10)
        || CASE WHEN pk % 4 = 0 THEN '    "same.' || key || '": {"text": "L"},' || chr(10) ELSE '' END || tail
        || CASE WHEN pk % 10 = 0 THEN 'oops' ELSE '' END END AS left_side
  FROM (SELECT *, '{' || chr(10) || '  "version": 1,' || chr(10) || '  "keys": {' || chr(10) AS head,
      '    "common": {"text": "c", "n": [' || (pk % 5) || ']}' || chr(10) || '  }' || chr(10) || '}' || chr(10) AS tail
    FROM x_files)""", x_files=FILES)
def conflict_sections(lake):
    return merging.conflict_sections(_files(lake)).select(
        "project", "path", "conflicted", "malformed", F.col("left").alias("left_side"))


MERGED = """
  SELECT project, path AS doc, unnest([
      {'p': '', 'v': NULL}, {'p': 'version', 'v': '1'}, {'p': 'keys', 'v': NULL},
      {'p': 'keys/common', 'v': NULL}, {'p': 'keys/common/text', 'v': '"c"'}, {'p': 'keys/common/n', 'v': '[' || (pk % 5) || ']'},
      {'p': 'keys/left.' || key, 'v': NULL}, {'p': 'keys/left.' || key || '/text', 'v': '"' || description || '"'},
      {'p': 'keys/right.' || key, 'v': NULL}, {'p': 'keys/right.' || key || '/text', 'v': '"' || description || '"'},
      CASE WHEN pk % 4 = 0 THEN {'p': 'keys/same.' || key, 'v': NULL} END,
      CASE WHEN pk % 4 = 0 THEN {'p': 'keys/same.' || key || '/text', 'v': '"L"'} END]) AS n
  FROM x_files WHERE torn AND NOT malformed AND NOT unparsable AND NOT clash"""


@query("merge_catalogs", "SELECT project, doc, n.p AS path, n.v AS value FROM x_merged WHERE n IS NOT NULL",
       x_files=FILES, x_merged=MERGED)
def merge_catalogs(lake):
    merged, _, _ = review.merge_conflicted(_files(lake))
    return merged.select("project", "doc", F.array_join("path", "/").alias("path"), "value")


@query("merge_findings", """
  SELECT project, 'L10N_E0088' AS code, path, CASE WHEN malformed THEN 'reason=markers'
    WHEN unparsable THEN 'reason=json' ELSE 'conflict_path=keys.same.' || key || '.text' END AS details
  FROM x_files WHERE malformed OR unparsable OR clash""", x_files=FILES)
def merge_findings(lake):
    return flat(review.merge_conflicted(_files(lake))[1], "project", "code", "path")


@query("merge_summary", """
  SELECT project, count(*) AS files_scanned, count(*) FILTER (torn AND NOT (malformed OR unparsable OR clash)) AS auto_merged,
    count(*) FILTER (malformed OR unparsable OR clash) AS failed FROM x_files GROUP BY project""", x_files=FILES)
def merge_summary(lake):
    return review.merge_conflicted(_files(lake))[2]


CANONICAL = """
  SELECT *, '{' || chr(10) || '  "keys": {' || chr(10) || '    "common": {' || chr(10) || '      "n": [' || chr(10) || '        ' || (pk % 5)
    || chr(10) || '      ],' || chr(10) || '      "text": "c"' || chr(10) || '    }' || CASE WHEN NOT torn THEN '' ELSE
      ',' || chr(10) || '    "left.' || key || '": {' || chr(10) || '      "text": "' || description || '"' || chr(10) || '    },' || chr(10)
      || '    "right.' || key || '": {' || chr(10) || '      "text": "' || description || '"' || chr(10) || '    }'
      || CASE WHEN pk % 4 = 0 THEN ',' || chr(10) || '    "same.' || key || '": {' || chr(10) || '      "text": "L"' || chr(10) || '    }' ELSE '' END END
    || chr(10) || '  },' || chr(10) || '  "version": 1' || chr(10) || '}' || chr(10) AS text FROM x_files"""


@query("repair_documents", """
  SELECT project, path, text FROM x_canonical WHERE NOT (malformed OR unparsable OR clash)""", x_files=FILES, x_canonical=CANONICAL)
def repair_documents(lake):
    return review.repair_documents(_files(lake))[0]


@query("repair_summary", """
  SELECT project, count(*) AS files_scanned, count(*) FILTER (torn AND NOT (malformed OR unparsable OR clash)) AS auto_merged,
    count(*) FILTER (malformed OR unparsable OR clash) AS failed, count(*) FILTER (NOT (malformed OR unparsable OR clash)) AS reformatted
  FROM x_files GROUP BY project""", x_files=FILES)
def repair_summary(lake):
    return review.repair_documents(_files(lake))[2]


# --- restoring -------------------------------------------------------------------------------
# Files are documents' lines of a catalog: one per entry key and locale, before and after a run.
def _file_state(lake):
    pk = F.col("pk")
    named = lake.entries.select("project", F.concat_ws("/", F.lit("l10n"), "locale", "key").alias("path"), "text", "pk")
    before = named.filter(pk % 6 != 0).select("project", "path", F.col("text").alias("content"))
    after = named.filter(pk % 10 != 0).select(
        "project", "path", F.when(pk % 4 == 0, F.concat("text", F.lit(" (new)"))).otherwise(F.col("text")).alias("content"))
    return named, before, after


STATE_FILES = """
  SELECT project, 'l10n/' || locale || '/' || key AS path, pk, CASE WHEN pk % 6 <> 0 THEN text END AS before,
    CASE WHEN pk % 10 <> 0 THEN CASE WHEN pk % 4 = 0 THEN text || ' (new)' ELSE text END END AS after FROM v_entries"""


@query("snapshot_write", """
  SELECT '20240501123456-sync' AS history_id, project, path, before AS content FROM x_files""", x_files=STATE_FILES)
def snapshot_write(lake):
    named, before, after = _file_state(lake)
    return restoring.snapshot_tables(before, restoring.managed_files(before, after, named), "20240501123456-sync")


@query("restore_as_of", """
  SELECT f.project, path, before AS content, CASE WHEN before IS NULL AND after IS NULL THEN 'keep'
      WHEN before IS NULL THEN 'delete' WHEN before IS NOT DISTINCT FROM after THEN 'keep' ELSE 'write' END AS action
  FROM x_files f SEMI JOIN v_history h ON h.project = f.project AND h.id = (SELECT min(id) FROM v_history)
  UNION ALL SELECT DISTINCT f.project, 'L10N_E0062', NULL, 'unknown' FROM x_files f
  ANTI JOIN v_history h ON h.project = f.project AND h.id = (SELECT min(id) FROM v_history)""", x_files=STATE_FILES)
def restore_as_of(lake):
    named, before, after = _file_state(lake)
    history_id = lake.history.agg(F.min("id")).first()[0]
    snapshots = restoring.snapshot_tables(before, restoring.managed_files(named), history_id)
    plan, unknown = sync_plan.restore(snapshots, after, lake.history, history_id)
    return plan.select("project", "path", "content", "action").unionByName(unknown.select(
        "project", F.col("code").alias("path"), F.lit(None).cast("string").alias("content"), F.lit("unknown").alias("action")))
