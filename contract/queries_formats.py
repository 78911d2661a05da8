"""Column expressions, document writers and readers, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.queries_core import PAIRS
from contract.registry import flat, query
from contract.views import Lake, names, used_placeholders
from lexilake.functions import escape, keys, locales, text as tx, tokens
from lexilake.functions.escape import json_string
from lexilake.functions.hashing import history_id, source_key_json
from lexilake.operators import audit
from lexilake.session import durable, shared_path, shuffled
from lexilake.sinks import catalogs as doc_sink, platforms as native
from lexilake.sources import android, catalogs, corpus, history, ios_strings, recorded, xcstrings
from lexilake.streaming import streams

# --- expressions -----------------------------------------------------------------------------
@query("plural_usage", r"""
  SELECT project, count(*) AS keys, count(*) FILTER (regexp_matches(text, '\{\s*[\w.-]+\s*,\s*plural\s*,')) AS plurals
  FROM v_source GROUP BY project""")
def plural_usage(lake):
    return lake.source.groupBy("project").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(tx.contains_plural(F.col("text"))).alias("plurals"))


@query("source_hash", "SELECT pk, key, source_hash FROM v_parts")
def source_hash_query(lake):
    return lake.parts.select("pk", "key", "source_hash")


@query("key_transform", """
  SELECT pk, replace(key, '.', '_') AS snake, replace(key, '.', '-') AS kebab, replace(replace(key, '.', '_'), '_', '.') AS back,
    key AS same FROM v_parts""")
def key_transform(lake):
    k = F.col("key")
    snake = keys.transform_key(k, "snake_case")
    return lake.parts.select(
        "pk", snake.alias("snake"), keys.transform_key(k, F.lit("kebab-case")).alias("kebab"),
        keys.reverse_key(snake, "snake_case").alias("back"), keys.transform_key(k, "identity").alias("same"))


@query("locale_dirs", """
  SELECT locale, d AS directory, locale AS back, 'app/res/' || d || '/strings.xml' AS android_path,
    'App/' || locale || '.lproj/L.strings' AS sibling, 'App/x/' || locale || '.lproj/L.strings' AS nested, n
  FROM (SELECT locale, CASE locale WHEN 'pt-BR' THEN 'values-pt-rBR' WHEN 'zh-Hans' THEN 'values-b+zh+Hans'
      WHEN 'es-419' THEN 'values-b+es+419' ELSE 'values-' || locale END AS d, count(*) AS n FROM v_entries GROUP BY 1)""")
def locale_dirs(lake):
    loc, en = F.col("locale"), F.lit("en")
    return lake.entries.groupBy("locale").agg(F.count(F.lit(1)).alias("n")).select(
        "locale", locales.android_dir(loc).alias("directory"),
        locales.android_locale(locales.android_dir(loc)).alias("back"),
        locales.android_path(F.lit("app/res/values/strings.xml"), en, loc).alias("android_path"),
        locales.lproj_path(F.lit("App/en.lproj/L.strings"), en, loc).alias("sibling"),
        locales.lproj_path(F.lit("App/x/L.strings"), en, loc).alias("nested"), "n")


@query("xml_decode", """
  SELECT page_id, length(d)::BIGINT AS n, sha256(d) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(
    html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS d FROM pages)""")
def xml_decode(lake):
    return lake.table("pages").withColumn("d", escape.xml_decode(F.col("html"))).select(
        "page_id", F.length("d").cast("bigint").alias("n"), F.sha2("d", 256).alias("digest"))


# Text escaped for a resource and read back is the text, but for doubled percent signs.
@query("android_escape", """
  SELECT conv_id, turn, replace(replace(replace(text, '\r', ''), '%%', '%'), '%', '%') AS back FROM conversations""")
def android_escape(lake):
    clean = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("%%"), F.lit("%"))
    written = escape.android_escape(clean)
    return lake.table("conversations").select(
        "conv_id", "turn", F.replace(escape.android_decode(written), F.lit("%%"), F.lit("%")).alias("back"))


TOKENS = """
  SELECT pk, text, CASE WHEN pk % 29 = 0 THEN text WHEN pk % 5 = 0 THEN replace(text, '{name}', '%1$' || s)
    WHEN pk % 7 = 0 THEN replace(replace(text, '{0}', '%1$' || s), '{1}', '%2$' || d) ELSE text END AS out, platform
  FROM v_parts, (VALUES ('android', 's', 'd'), ('ios', '@', 'lld')) t(platform, s, d)"""


@query("platform_tokens", "SELECT pk, platform, out FROM x_tokens", x_tokens=TOKENS)
def platform_tokens(lake):
    listed = tx.canonical_placeholders(F.col("text"), F.col("placeholders"))
    typed = lake.parts.select("pk", "text", listed.alias("ph"))
    out = [typed.select("pk", F.lit(p).alias("platform"),
                        tokens.to_platform_tokens(F.col("text"), F.col("ph"), p).alias("out")) for p in ("android", "ios")]
    return out[0].unionByName(out[1])


@query("locale_valid", r"""
  SELECT code, count(*) AS n, regexp_full_match(code, '[a-z]{2,3}(-[A-Za-z]{4})?(-([A-Z]{2}|\d{3}))?') AS valid FROM (
    SELECT CASE pk % 5 WHEN 0 THEN upper(locale) WHEN 1 THEN locale || '-latn' WHEN 2 THEN locale || '-Latn-XX'
      WHEN 3 THEN locale || chr(10) ELSE locale END AS code FROM v_entries) GROUP BY 1""")
def locale_valid(lake):
    m, loc = F.col("pk") % 5, F.col("locale")
    code = (F.when(m == 0, F.upper("locale")).when(m == 1, F.concat(loc, F.lit("-latn")))
            .when(m == 2, F.concat(loc, F.lit("-Latn-XX"))).when(m == 3, F.concat(loc, F.lit("\n"))).otherwise(loc))
    return lake.entries.select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "valid", locales.valid_locale(F.col("code")))


@query("history_ids", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || event_type AS id FROM events")
def history_ids(lake):
    return lake.table("events").select("event_id", history_id(F.col("ts"), F.col("event_type")).alias("id"))


_LANES = " || '|' || ".join(
    f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query("catalog_fingerprint", f"""
  SELECT project, 'sha256:' || sha256(count(*) || '|' || {_LANES}) AS fingerprint
  FROM (SELECT project, sha256(key || chr(31) || source_hash) AS h FROM v_source) GROUP BY project""")
def catalog_fingerprint(lake):
    return doc_sink.catalog_fingerprint(lake.source)


@query("classify_failure", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 'L10N_E0053' ELSE 'L10N_E0054' END AS code,
    CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'session_files' WHEN 'click' THEN 'state_database'
      WHEN 'purchase' THEN 'thread_start' ELSE 'exit' END AS reason,
    CASE event_type WHEN 'view' THEN '/u/' || user_id WHEN 'click' THEN '/db' || user_id
      WHEN 'purchase' THEN 'Error: thread/start: no ' || user_id END AS detail FROM events""")
def classify_failure(lake):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    stderr = (
        F.when(kind == "error", F.concat(F.lit("HTTP Too Many Requests "), user))
        .when(kind == "view", F.concat(F.lit("Tool cannot access session files at /u/"), user, F.lit(" (permission denied)")))
        .when(kind == "click", F.concat(F.lit("failed to open state db at /db"), user, F.lit(": attempt to write a readonly database")))
        .when(kind == "purchase", F.concat(F.lit("x\n  Error: thread/start: no "), user, F.lit("  \ny"))).otherwise("boom"))
    return lake.table("events").withColumn("f", tx.classify_failure(stderr, F.lit(""))).select(
        "event_id", "f.code", "f.reason", "f.detail")


# --- writers ---------------------------------------------------------------------------------
@query("render_catalog", """
  SELECT project, locale, key AS sort_key, 1 AS section, '    ' || to_json(key)::VARCHAR || ': {' || chr(10)
    || '      "model_version": "' || model_version || '",' || chr(10) || '      "provider": "machine",' || chr(10)
    || '      "reviewed": ' || reviewed || ',' || chr(10) || '      "source_hash": "' || source_hash || '",' || chr(10)
    || '      "stale": ' || stale || ',' || chr(10) || '      "text": ' || to_json(text)::VARCHAR || ',' || chr(10)
    || '      "translated_at": "' || strftime(translated_at, '%Y-%m-%dT%H:%M:%S') || '.000Z"' || chr(10) || '    }'
    || CASE WHEN key = last_value(key) OVER w THEN '' ELSE ',' END AS fragment FROM v_entries
  WINDOW w AS (PARTITION BY project, locale ORDER BY lower(key) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  UNION ALL SELECT DISTINCT project, locale, '', 0, '{' || chr(10) || '  "entries": {' FROM v_entries
  UNION ALL SELECT DISTINCT project, locale, '', 2, '  },' || chr(10) || '  "locale": "' || locale || '",' || chr(10)
    || '  "version": 1' || chr(10) || '}' FROM v_entries""")
def render_catalog(lake):
    return doc_sink.render_catalog(lake.entries)


def _canonical(lake):
    rows = audit.canonical_entries(lake.entries, lake.source).select("project", "locale", "key", "text", "placeholders")
    return audit.canonical_source(lake.source).drop("comment").unionByName(rows)


CANONICAL = f"""
  SELECT project, 'en' AS locale, key, text, {used_placeholders('text', 'ph')} AS ph, pk, description FROM v_source
  UNION ALL SELECT e.project, e.locale, e.key, e.text, {used_placeholders('e.text', 'coalesce(s.ph, [])')}, e.pk, NULL
  FROM v_entries e LEFT JOIN v_source s ON s.project = e.project AND s.key = e.key"""
# Placeholders the text uses, and the text with its tokens.
NATIVE = f"""
  SELECT *, list_reduce(list_prepend(text, list_transform(used, lambda u, i:
      '{{' || u.n || '}}' || chr(1) || '%' || i || '$' || CASE u.t WHEN 'number' THEN 'd' ELSE 's' END)),
      lambda acc, r: replace(acc, split_part(r, chr(1), 1), split_part(r, chr(1), 2))) AS tokens
  FROM (SELECT *, list_filter(ph, lambda p: list_contains({names('text')}, p.n)) AS used FROM x_canonical
        WHERE NOT regexp_matches(text, '\\{{\\s*[\\w.-]+\\s*,\\s*plural\\s*,'))"""
DIRS = """CASE locale WHEN 'en' THEN 'values' WHEN 'pt-BR' THEN 'values-pt-rBR' WHEN 'zh-Hans' THEN 'values-b+zh+Hans'
  WHEN 'es-419' THEN 'values-b+es+419' ELSE 'values-' || locale END"""
NATIVE_VIEWS = {"x_canonical": CANONICAL, "x_native": NATIVE}


@query("export_android", f"""
  SELECT project, locale, 'res/' || {DIRS} || '/strings.xml' AS path, key AS sort_key, 1 AS section,
    CASE WHEN len(used) > 0 THEN '  <!-- lexilake-meta {{"placeholders":[' || array_to_string(list_transform(used,
      lambda u: '{{"name":"' || u.n || '","type":"' || u.t || '"}}'), ',') || ']}} -->' || chr(10) ELSE '' END
    || '  <string name="' || replace(key, '.', '_') || '">' || tokens || '</string>' AS fragment FROM x_native
  UNION ALL SELECT DISTINCT project, locale, 'res/' || {DIRS} || '/strings.xml', '', 0,
    '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' FROM x_native
  UNION ALL SELECT DISTINCT project, locale, 'res/' || {DIRS} || '/strings.xml', '', 2, '</resources>' FROM x_native""",
       **NATIVE_VIEWS)
def export_android(lake):
    return native.export_android(_canonical(lake), "res/values/strings.xml", key_transform="snake_case")


@query("export_ios_strings", """
  SELECT project, locale, locale || '.lproj/L.strings' AS path, key AS sort_key, 1 AS section,
    to_json(key)::VARCHAR || ' = ' || to_json(text)::VARCHAR || ';' AS fragment FROM x_canonical""", **NATIVE_VIEWS)
def export_ios_strings(lake):
    return native.export_ios_strings(_canonical(lake), "en.lproj/L.strings")


def _with_comments(lake):
    rows = audit.canonical_entries(lake.entries, lake.source).select(
        "project", "locale", "key", "text", F.lit(None).cast("string").alias("comment"), "placeholders")
    return audit.canonical_source(lake.source).select(rows.columns).unionByName(rows)


@query("export_xcstrings", r"""
  SELECT project, sort_key, n_locales, comment, sample FROM (
    SELECT project, key AS sort_key, count(*) AS n_locales, max(description) AS comment,
      max(CASE WHEN locale = 'en' THEN replace(replace(tokens, '$s', '$@'), '$d', '$lld') END) AS sample
    FROM x_native GROUP BY ALL)""", **NATIVE_VIEWS)
def export_xcstrings(lake):
    body = native.export_xcstrings(_with_comments(lake), "L.xcstrings").filter("section = 1")
    parsed = F.from_json(F.concat(F.lit("{"), F.regexp_replace("fragment", r",\z", ""), F.lit("}")),
                         "map<string,struct<comment:string,localizations:map<string,struct<stringUnit:struct<value:string>>>>>")
    entry = F.element_at(F.map_values(parsed), 1)
    return body.withColumn("e", entry).select(
        "project", "sort_key", F.size("e.localizations").cast("bigint").alias("n_locales"), "e.comment",
        F.try_element_at("e.localizations", F.lit("en"))["stringUnit"]["value"].alias("sample"))


# --- readers ---------------------------------------------------------------------------------
# Small documents, one per key or entry, some broken; the expected rows are the ones written.
@query("scan_source_catalog", """
  SELECT pk % 4 AS project, key, text, description, source_hash, '' AS code FROM v_parts
    WHERE pk % 41 <> 0 AND pk % 43 <> 1 AND pk % 47 <> 2 AND pk % 53 <> 3
  UNION ALL SELECT pk % 4, 'd' || pk, NULL, NULL, NULL, 'L10N_E0010' FROM v_parts
    WHERE NOT (pk % 41 <> 0 AND pk % 43 <> 1 AND pk % 47 <> 2 AND pk % 53 <> 3)""")
def scan_source_catalog(lake):
    pk = F.col("pk")
    good = F.concat(F.lit('{"version": '), F.when(pk % 41 == 0, "2").otherwise("1"), F.lit(', "keys": {'),
                    json_string(F.col("key")), F.lit(": "), source_key_json(
                        F.when(pk % 53 == 3, "").otherwise(F.col("text")), F.col("description"), F.col("placeholders")),
                    F.lit("}}\n"))
    text = F.when(pk % 43 == 1, F.substring(good, F.lit(1), F.length(good) - 4)).when(
        pk % 47 == 2, F.concat(good, F.lit("junk"))).otherwise(good)
    docs = lake.parts.select((pk % 4).cast("int").alias("project"), F.concat(F.lit("d"), pk.cast("string")).alias("path"),
                             text.alias("text"))
    rows, bad = catalogs.parse_source_catalogs(durable(docs))
    null = F.lit(None).cast("string")
    return rows.select("project", "key", "text", "description", "source_hash", F.lit("").alias("code")).unionByName(
        bad.select("project", F.col("path").alias("key"), null.alias("text"), null.alias("description"),
                   null.alias("source_hash"), "code"))


@query("scan_translations", """
  SELECT project, locale, key, text, CASE WHEN pk % 47 = 2 THEN false ELSE reviewed END AS reviewed, translated_at
  FROM v_entries WHERE pk % 41 <> 0 AND pk % 43 <> 1
  UNION ALL SELECT project, 'bad', 'L10N_E0011', count(*)::VARCHAR, NULL, NULL FROM v_entries
  WHERE pk % 41 = 0 OR pk % 43 = 1 GROUP BY project""")
def scan_translations(lake):
    pk = F.col("pk")
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), json_string(value))
    item = F.concat_ws(
        ", ", field("text", F.col("text")), field("model_version", F.col("model_version")),
        F.when(pk % 43 != 1, field("provider", F.col("provider"))),
        F.when(pk % 47 != 2, F.concat(F.lit('"reviewed": '), F.col("reviewed").cast("string"))),
        field("source_hash", F.when(pk % 41 == 0, "none").otherwise(F.col("source_hash"))),
        field("translated_at", doc_sink.iso_instant(F.col("translated_at"))))
    docs = lake.entries.select("project", F.concat_ws("/", "locale", "key").alias("path"), F.concat(
        F.lit('{"version": 1, "locale": '), json_string(F.col("locale")), F.lit(', "entries": {'),
        json_string(F.col("key")), F.lit(": {"), item, F.lit("}}}")).alias("text"))
    rows, bad = catalogs.parse_translations(durable(docs))
    counted = bad.groupBy("project", "code").agg(F.count(F.lit(1)).cast("string").alias("text"))
    return rows.select("project", "locale", "key", "text", "reviewed", "translated_at").unionByName(counted.select(
        "project", F.lit("bad").alias("locale"), F.col("code").alias("key"), "text",
        F.lit(None).cast("boolean").alias("reviewed"), F.lit(None).cast("timestamp_ntz").alias("translated_at")))


@query("cache_version_gate", """
  SELECT project, CASE pk % 5 WHEN 0 THEN 'L10N_E0086' WHEN 1 THEN 'L10N_E0086' WHEN 2 THEN 'L10N_E0060'
    WHEN 3 THEN CASE WHEN pk % 3 = 0 THEN 'L10N_E0060' ELSE 'row' END ELSE 'row' END AS kind, count(*) AS n
  FROM v_entries GROUP BY ALL""")
def cache_version_gate(lake):
    pk = F.col("pk")
    version = F.when(pk % 5 == 0, "1").when(pk % 5 == 1, "2").when(pk % 5 == 2, "9").otherwise("3")
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), json_string(value))
    broken = (pk % 5 == 3) & (pk % 3 == 0)
    item = F.concat_ws(
        ", ", field("source_hash", F.col("source_hash")), field("locale", F.when(broken, "xx-y").otherwise(F.col("locale"))),
        field("config_hash", F.col("source_hash")), field("model_version", F.col("model_version")),
        field("text", F.col("text")), field("cached_at", doc_sink.iso_instant(F.col("translated_at"))))
    docs = lake.entries.select("project", F.concat_ws("/", "locale", "key").alias("path"), F.concat(
        F.lit('{"version": '), version, F.lit(', "entries": [{'), item, F.lit("}]}")).alias("text"))
    rows, found = catalogs.parse_cache(durable(docs))
    return rows.select("project", F.lit("row").alias("kind")).unionByName(
        found.select("project", F.col("code").alias("kind"))).groupBy("project", "kind").agg(
        F.count(F.lit(1)).alias("n"))


LOGS = """
  SELECT l_orderkey AS ok, (l_orderkey % 4)::INT AS project, count(*) AS n, l_orderkey % 7 = 0 AS fatal,
    l_orderkey % 5 = 0 AS cut FROM lineitem GROUP BY ALL"""


@query("history_corrupt_tail", """
  SELECT project, ok AS log, CASE WHEN fatal THEN 'L10N_E0062' WHEN cut THEN 'L10N_E0078' ELSE 'fine' END AS outcome,
    CASE WHEN fatal THEN 0 ELSE n END AS rows, CASE WHEN fatal THEN 1 WHEN cut THEN n + 1 END AS line FROM x_logs""",
       x_logs=LOGS)
def history_corrupt_tail(lake):
    ok = F.col("l_orderkey")
    row = F.concat(F.lit('{"id": "'), ok.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                   F.lit('", "op": "sync", "actor": "a", "ts": "2024-01-01T00:00:00.000Z", "summary": "s"}\n'))
    logs = lake.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "").alias("body"))
    docs = logs.select(
        (ok % 4).cast("int").alias("project"), ok.cast("string").alias("path"),
        F.concat(F.when(ok % 7 == 0, '{"id": 5}\n').otherwise(""), "body",
                 F.when(ok % 5 == 0, '{"id": "x", "op": "syn').otherwise(""), F.lit("\n\n")).alias("text"))
    docs = durable(docs)
    rows, found = history.parse_history_lines(history.document_lines(docs))
    counts = rows.groupBy("project", "path").agg(F.count(F.lit(1)).alias("rows"))
    return docs.select("project", "path").join(shuffled(counts), ["project", "path"], "left").join(
        shuffled(found.select("project", "path", "code", F.col("details")["line"].cast("bigint").alias("line"))),
        ["project", "path"], "left").select(
        "project", F.col("path").cast("bigint").alias("log"), F.coalesce("code", F.lit("fine")).alias("outcome"),
        F.coalesce("rows", F.lit(0)).alias("rows"), "line")


@query("snapshot_scan", """
  SELECT 'h' || pk AS history_id, pk % 4 AS project, 'l10n/' || key AS path, CASE WHEN pk % 3 <> 0 THEN text END AS content
  FROM v_parts WHERE pk % 10 <> 0
  UNION ALL SELECT 'L10N_E0062', pk % 4, 's/h' || pk || '.json', NULL FROM v_parts WHERE pk % 10 = 0""")
def snapshot_scan(lake):
    pk = F.col("pk")
    content = F.when(pk % 10 == 0, "7").when(pk % 3 == 0, "null").otherwise(json_string(F.col("text")))
    docs = lake.parts.select(
        (pk % 4).cast("int").alias("project"), F.concat(F.lit("s/h"), pk.cast("string"), F.lit(".json")).alias("path"),
        F.concat(F.lit('{"version": 1, "files": {"l10n/'), F.col("key"), F.lit('": '), content, F.lit("}}")).alias("text"))
    rows, bad = history.parse_snapshots(docs)
    return rows.unionByName(bad.select(F.col("code").alias("history_id"), "project", "path",
                                       F.lit(None).cast("string").alias("content")))


def _native_docs(fragments, header, footer):
    """One document per fragment: every entry of the lake passes through the reader."""
    return fragments.filter("section = 1").select(
        "project", "locale", F.concat_ws("/", "locale", "sort_key").alias("path"),
        F.concat(F.lit(header), F.regexp_replace("fragment", r",\z", ""), F.lit(footer)).alias("text")).transform(durable)


def _listed(column="placeholders"):
    return F.array_join(F.transform(column, lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|")


READ_BACK = ("SELECT project, '{0}' AS platform, locale, key, text, "
             "array_to_string(list_transform(used, lambda u: u.n || ':' || {1}), '|') AS placeholders FROM x_native")


@query("ingest_android", READ_BACK.format("android", "u.t"), **NATIVE_VIEWS)
def ingest_android(lake):
    docs = _native_docs(
        native.export_android(_canonical(lake), "res/values/strings.xml"),
        '<?xml version="1.0" encoding="utf-8"?>\n<resources>\n<!-- a note -->\n', "\n</resources>\n")
    rows, _ = android.parse_android_strings(docs)
    return rows.select("project", "platform", "locale", "key", "text", _listed().alias("placeholders"))


@query("ingest_android_findings", """
  SELECT pk, CASE pk % 8 WHEN 0 THEN 'L10N_E0031' WHEN 1 THEN 'L10N_E0042' WHEN 2 THEN 'L10N_E0032' WHEN 3 THEN 'L10N_E0032'
    WHEN 4 THEN 'L10N_E0041' WHEN 5 THEN 'L10N_E0032' WHEN 6 THEN 'L10N_E0031' END AS code FROM v_parts WHERE pk % 8 <> 7""")
def ingest_android_findings(lake):
    pk = F.col("pk")
    string = F.concat(F.lit('<string name="'), F.col("key"), F.lit('">x %s</string>'))
    body = (
        F.when(pk % 8 == 0, F.concat(string, F.lit("</resource>")))
        .when(pk % 8 == 1, F.concat(F.lit("<resources><plurals name='p'><item/></plurals>"), string, F.lit("</resources>")))
        .when(pk % 8 == 2, F.concat(F.lit("<resources>stray"), string, F.lit("</resources>")))
        .when(pk % 8 == 3, F.concat(F.lit("<resources><string-array name='a'><item>x</item></string-array>"), F.lit("</resources>")))
        .when(pk % 8 == 4, F.concat(F.lit('<resources><!-- lexilake-meta {"placeholders":[{"name":"a","type":"string"},'
                                          '{"name":"b","type":"date"}]} -->'), string, F.lit("</resources>")))
        .when(pk % 8 == 5, F.lit("<resources><string id=\"k\">x</string></resources>"))
        .when(pk % 8 == 6, F.lit("<resources><string name=\"k\">x</string><item/></resources>"))
        .otherwise(F.concat(F.lit("<resources><string name=\"t\" translatable=\"false\">x</string>"), string, F.lit("</resources>"))))
    docs = lake.parts.select(F.lit(0).alias("project"), pk.cast("string").alias("path"), F.lit("de").alias("locale"), body.alias("text"))
    return android.parse_android_strings(docs)[1].select(F.col("path").cast("bigint").alias("pk"), "code")


@query("ingest_ios_strings", """
  SELECT project, 'ios' AS platform, locale, key, text, array_to_string(list_transform(list_filter(ph,
    lambda p: list_contains(regexp_extract_all(text, '\\{([\\w.-]+)\\}', 1), p.n)), lambda u: u.n || ':string'), '|') AS placeholders
  FROM x_canonical""", **NATIVE_VIEWS)
def ingest_ios_strings(lake):
    docs = _native_docs(native.export_ios_strings(_canonical(lake), "en.lproj/L.strings"), "// a note\n/* and ; more */ ", "\n")
    rows, _ = ios_strings.parse_ios_strings(docs)
    return rows.select("project", "platform", "locale", "key", "text", _listed().alias("placeholders"))


@query("ingest_xcstrings", READ_BACK.format("ios", "u.t"), **NATIVE_VIEWS)
def ingest_xcstrings(lake):
    fragments = native.export_xcstrings(_with_comments(lake), "L.xcstrings").withColumn("locale", F.lit("en"))
    docs = _native_docs(fragments, '{"sourceLanguage": "en", "strings": {\n', '\n}, "version": "1.0"}\n').drop("locale")
    rows, _ = xcstrings.parse_xcstrings(docs)
    return rows.select("project", "platform", "locale", "key", "text", _listed().alias("placeholders"))


@query("ingest_xcstrings_findings", """
  SELECT pk, CASE pk % 7 WHEN 0 THEN 'L10N_E0031' WHEN 1 THEN 'L10N_E0042' WHEN 2 THEN 'L10N_E0032' WHEN 3 THEN 'L10N_E0032'
    WHEN 4 THEN 'L10N_E0040' ELSE 'L10N_E0041' END AS code FROM v_parts""")
def ingest_xcstrings_findings(lake):
    pk = F.col("pk")
    unit = '"stringUnit": {"state": "new", "value": "x %1$@"}'
    sub = lambda inner: f'"substitutions": {{"n": {{{inner}}}}}'
    local = (
        F.when(pk % 7 == 1, f'{unit}, {sub(chr(34) + "argNum" + chr(34) + ": 1, " + chr(34) + "variations" + chr(34) + ": {" + chr(34) + "plural" + chr(34) + ": {}}")}')
        .when(pk % 7 == 2, f'{unit}, {sub(chr(34) + "argNum" + chr(34) + ": 1, " + chr(34) + "variations" + chr(34) + ": {" + chr(34) + "device" + chr(34) + ": {}}")}')
        .when(pk % 7 == 3, '"variations": {"plural": {"one": {}}}')
        .when(pk % 7 == 4, f'{unit}, {sub(chr(34) + "formatSpecifier" + chr(34) + ": " + chr(34) + "%@" + chr(34))}')
        .when(pk % 7 == 5, unit)
        .otherwise(f'{unit}, {sub(chr(34) + "argNum" + chr(34) + ": 2")}'))
    version = F.when(pk % 7 == 0, "1").otherwise('"1.0"')
    docs = lake.parts.select(F.lit(0).alias("project"), pk.cast("string").alias("path"), F.concat(
        F.lit('{"sourceLanguage": "en", "version": '), version, F.lit(', "strings": {"'), F.col("key"),
        F.lit('": {"localizations": {"de": {'), local, F.lit("}}}}}")).alias("text"))
    return xcstrings.parse_xcstrings(docs)[1].select(F.col("path").cast("bigint").alias("pk"), "code")


@query("corpus_scan", """
  SELECT page_id, length(html)::BIGINT AS n FROM pages
  WHERE page_id % 6 IN (0, 1, 4) AND NOT contains(html, chr(0))""")
def corpus_scan(lake):
    m, page = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = (F.when(m == 0, F.concat(F.lit("src/p"), page, F.lit(".TS"))).when(m == 1, F.concat(F.lit("a.b/c/p"), page, F.lit(".min.js")))
            .when(m == 2, F.concat(F.lit("src/p"), page, F.lit(".html"))).when(m == 3, F.concat(F.lit("x/node_modules/p"), page, F.lit(".ts")))
            .when(m == 4, F.concat(F.lit("p"), page, F.lit(".xml"))).otherwise(F.concat(F.lit("src/.ts"))))
    docs = lake.table("pages").select(F.lit(0).alias("project"), path.alias("path"), F.col("html").alias("text"), "page_id")
    return corpus.text_corpus(docs).select("page_id", F.length("text").cast("bigint").alias("n"))


@query("parse_recorded_responses", """
  SELECT pk, text AS source_text, CASE WHEN pk % 6 IN (0, 1) THEN '[de] ' || text END AS text,
    CASE pk % 6 WHEN 2 THEN 'L10N_E0053' WHEN 3 THEN 'L10N_E0055' WHEN 4 THEN 'L10N_E0055' WHEN 5 THEN 'L10N_E0055' END AS error_code
  FROM v_parts""")
def parse_recorded_responses(lake):
    pk = F.col("pk")
    answer = F.concat(F.lit('{"text": '), json_string(F.concat(F.lit("[de] "), F.col("text"))), F.lit("}"))
    event = lambda payload: F.concat(
        F.lit('{"type": "item.completed", "item": {"type": "agent_message", "text": '), json_string(payload), F.lit("}}\n"))
    stdout = (
        F.when(pk % 6 == 1, F.concat(event(F.lit("draft")), event(answer), F.lit('{"type": "turn.completed"}\n')))
        .when(pk % 6 == 3, F.concat(event(answer), F.lit("not json\n")))
        .when(pk % 6 == 4, F.lit('{"type": "turn.completed"}\n'))
        .when(pk % 6 == 5, event(F.lit("no object"))).otherwise(event(answer)))
    docs = lake.parts.select(F.lit(0).alias("project"), pk.cast("string").alias("path"), F.concat(
        F.lit('{"records": [{"request": {"sourceLocale": "en", "targetLocale": "de", "sourceText": '), json_string(F.col("text")),
        F.lit('}, "response": {"exitCode": '), F.when(pk % 6 == 2, "1").otherwise("0"), F.lit(', "stdout": '), json_string(stdout),
        F.lit(', "stderr": '), F.when(pk % 6 == 2, '"quota exceeded"').otherwise('""'), F.lit("}}]}")).alias("text"))
    return recorded.parse_recorded_responses(docs).select(F.col("path").cast("bigint").alias("pk"), "source_text", "text", "error_code")


# --- streams ---------------------------------------------------------------------------------
def _stream(lake, table):
    return lake.spark.readStream.schema(lake.table(table).schema).option(
        "pathGlobFilter", f"{table}.parquet").parquet(lake.sf_dir)


def _drain(lake, stream, mode):
    """Run a stream over what there is and give its result as a table in the shared folder."""
    home = shared_path(lake.spark, "stream")

    def store(batch, batch_id):
        # Complete mode replaces the table, append mode adds to it; a replayed batch overwrites itself.
        part = "all" if mode == "complete" else str(batch_id)
        batch.write.mode("overwrite").parquet(f"{home}/rows/part={part}")

    stream.writeStream.outputMode(mode).foreachBatch(store).option(
        "checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return lake.spark.read.schema(stream.schema).parquet(f"{home}/rows").select(*stream.columns)


@query("stream_history", "SELECT project, count(*) AS entries, arg_max(ts, line_no) AS last_at FROM v_history GROUP BY project")
def stream_history(lake):
    return _drain(lake, streams.stream_history(Lake.history_of(_stream(lake, "events"))), "complete")


@query("live_status", """
  SELECT project, completed_translations, total_translations, status,
    CASE WHEN total_translations = 0 THEN 100.0 ELSE least(100.0, round(completed_translations / total_translations * 100, 1))
      END::DOUBLE AS percent_complete,
    greatest(0, total_translations - completed_translations) AS remaining, updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, completed_translations DESC) AS rn
        FROM v_states) WHERE rn = 1""")
def live_status(lake):
    return _drain(lake, streams.live_status(Lake.states_of(_stream(lake, "events"))), "complete")


@query("stalled_runs", """
  SELECT project, min(seen) AS started_at, max(seen) + INTERVAL 10 MINUTE AS stalled_at, count(*) AS reports FROM (
    SELECT project, seen, sum(fresh) OVER (PARTITION BY project ORDER BY seen ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT project, updated_at AS seen, CASE WHEN updated_at > lag(updated_at) OVER (
        PARTITION BY project ORDER BY updated_at) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM v_states))
  GROUP BY project, run
  HAVING max(seen) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stalled_runs(lake):
    return _drain(lake, streams.stalled_runs(Lake.states_of(_stream(lake, "events"))), "append").select(
        "project", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("stalled_at").cast("timestamp_ntz").alias("stalled_at"), "reports")


@query("incremental_staleness", "SELECT project, locale, key, reason, source_hash FROM x_pairs "
                                "WHERE reason IN ('missing', 'stale')", x_pairs=PAIRS)
def incremental_staleness(lake):
    home = shared_path(lake.spark, "tasks")
    changes = Lake.source_of(Lake.parts_of(_stream(lake, "part")))
    streams.incremental_staleness(
        changes, lambda: (lake.entries, lake.locales, lake.cache, lake.configs),
        lambda tasks, batch_id: tasks.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}"),
        f"{home}/checkpoint").awaitTermination()
    return lake.spark.read.parquet(f"{home}/rows").select("project", "locale", "key", "reason", "source_hash")
