import datetime
import json

import pytest
from lexilake import schemas
from lexilake.operators import applying, merging, planning, renaming, restoring, rows as row_ops
from lexilake.plans import rename, review, sync
from lexilake.providers import PLATFORM_FORMATS, plan_renames
from lexilake.sinks import platforms as native
from lexilake.sources import android, catalogs, history, ios_strings, recorded, xcstrings
from pyspark.sql import functions as F

import rows as t

DOCS = "project int, path string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([(0, f"d{i}", x) for i, x in enumerate(texts)], DOCS)


def codes(df):
    return sorted(r.code for r in df.collect())


# --- readers ---------------------------------------------------------------------------------
XC = {"sourceLanguage": "en", "version": "1.0", "strings": {
    "events_starts": {"comment": "Label.", "localizations": {
        "en": {"stringUnit": {"state": "translated", "value": "Starts at %1$@, %2$lld left"},
               "substitutions": {"date": {"argNum": 1, "formatSpecifier": "date"}, "n": {"argNum": 2, "formatSpecifier": "%lld"}}},
        "de": {"stringUnit": {"state": "translated", "value": "%2$lld ab %1$@"},
               "substitutions": {"n": {"argNum": 2, "formatSpecifier": "%lld"}, "date": {"argNum": 1, "formatSpecifier": "date"}}}}},
    "plain": {"localizations": {"en": {"stringUnit": {"state": "new", "value": "100% fun"}}}}}}


def test_xcstrings(spark):
    got, bad = xcstrings.parse_xcstrings(docs(spark, json.dumps(XC), "{", json.dumps({**XC, "version": ""})), "snake_case")
    found = {(r.locale, r.key): (r.text, r.comment, [(p["name"], p["type"]) for p in r.placeholders]) for r in got.collect()}
    assert found == {
        ("en", "events.starts"): ("Starts at {date}, {n} left", "Label.", [("date", "date"), ("n", "number")]),
        ("de", "events.starts"): ("{n} ab {date}", "Label.", [("n", "number"), ("date", "date")])} | (
        {("en", "plain"): found[("en", "plain")]} if ("en", "plain") in found else {})
    assert codes(bad).count("L10N_E0031") == 2


ANDROID = """<?xml version="1.0" encoding="utf-8"?>
<resources>
  <!-- lexilake-meta {"placeholders":[{"name":"name","type":"string"},{"name":"n","type":"number"}]} -->
  <string name="a_b">Hi %1$s, 50%% of %2$d &amp; \\'more\\'</string>
  <!-- just a note -->
  <string name="c">%s %d</string>
  <!-- lexilake-meta {"placeholders":[]} -->
  <string name="x" translatable="false">%1$s</string>
</resources>
"""


def test_android(spark):
    frame = docs(spark, ANDROID, "<resources><plurals name='p'></plurals></resources>", "<nope/>",
                 "<resources><string name='k'>x</string></resources>").withColumn("locale", F.lit("de"))
    got, bad = android.parse_android_strings(frame, key_transform="snake_case")
    assert {r.key: (r.text, [(p["name"], p["type"]) for p in r.placeholders]) for r in got.collect()} == {
        "a.b": ("Hi {name}, 50% of {n} & 'more'", [("name", "string"), ("n", "number")]),
        "c": ("{arg1} {arg2}", [("arg1", "string"), ("arg2", "number")])}
    assert codes(bad) == ["L10N_E0031", "L10N_E0032", "L10N_E0042"]


def test_android_round_trip_through_files(spark, tmp_path):
    from lexilake.sinks.documents import write_files

    canonical = spark.createDataFrame([
        (0, "en", "a.b", "Hi {name} \"q\" \\ 5%", None, [("name", "string")]), (0, "pt-BR", "a.b", "@Oi {name}\n?", None, [("name", "string")])],
        "project int, locale string, key string, text string, comment string, placeholders array<struct<name:string,type:string>>")
    out = native.export_android(canonical, "res/values/strings.xml")
    assert {r.path for r in out.collect()} == {"res/values/strings.xml", "res/values-pt-rBR/strings.xml"}
    write_files(out, ["project", "locale"], str(tmp_path / "x"))
    back, bad = PLATFORM_FORMATS["android"].ingest(spark, str(tmp_path / "x"), glob="part-*", project_pattern=r"project=([0-9]+)")
    assert bad.count() == 0
    assert {r.text for r in back.collect()} == {"Hi {name} \"q\" \\ 5%", "@Oi {name}\n?"}


def test_comments_of_an_existing_catalog_stay(spark):
    schema = "project int, locale string, key string, text string, comment string, placeholders array<struct<name:string,type:string>>"
    new = spark.createDataFrame([(0, "en", "a", "A", None, []), (0, "de", "a", "B", None, []), (0, "en", "b", "B", "own", [])], schema)
    old = spark.createDataFrame([(0, "en", "a", "x", "kept", []), (0, "en", "b", "x", "lost", []), (0, "en", "gone", "x", "gone", [])], schema)
    body = {r.sort_key: r.fragment for r in native.export_xcstrings(new, "L.xcstrings", existing=old).filter("section = 1").collect()}
    assert set(body) == {"a", "b"} and '"comment": "kept"' in body["a"] and '"comment": "own"' in body["b"]
    before = spark.createDataFrame([(0, "de", "x"), (0, "es", "y")], "project int, locale string, path string")
    assert [r.locale for r in native.removed_files(before, before.filter("locale = 'de'")).collect()] == ["es"]


@pytest.mark.parametrize("text,want", [
    ('"a" = "x";\n/* c */ "b.c"="y \\"q\\" \\u00e9" ; // end', {"a": "x", "b.c": 'y "q" é'}),
    ('"a" = "x"', None), ('"a" "x";', None), ("", {}), ('"a" = "1"; "a" = "2";', {"a": "2"}), ('"a" = "raw\nline";', None),
    ("/* open", {}), ('"a\\q" = "x";', None)])
def test_ios_strings(spark, text, want):
    got, bad = ios_strings.parse_ios_strings(docs(spark, text))
    assert {r.key: r.text for r in got.collect()} == (want or {})
    assert bad.count() == (1 if want is None else 0)


def test_long_escaped_values_do_not_exhaust_the_scanner():
    assert ios_strings._pairs('"k" = "' + "\\n" * 50000 + '";')[0][1] == "\n" * 50000
    assert ios_strings._pairs(" " * 50000 + "x") is None


def line(**kw):
    return json.dumps({"id": "1", "actor": "a", "ts": "2024-01-01T00:00:00.000Z", **kw})


@pytest.mark.parametrize("text,n,found", [
    (line(op="sync", summary="s") + "\n" + line(op="rename", before="a", after="b") + "\n", 2, []),
    (line(op="sync", summary="s") + '\n{"id": ', 1, ["L10N_E0078"]),
    (line(op="sync", summary="s") + "\n" + line(op="rename", before="a") + "\n\n", 1, ["L10N_E0078"]),
    (line(op="sync", summary="s") + "\n\n" + line(op="init", summary="s"), 0, ["L10N_E0062"]),
    ("oops\n" + line(op="init", summary="s"), 0, ["L10N_E0062"]),
    (line(op="init", summary="s") + "\n   \n", 1, []), ("", 0, [])])
def test_history(spark, text, n, found):
    got, bad = history.parse_history_lines(history.document_lines(docs(spark, text)))
    assert got.count() == n and codes(bad) == found


def test_cache_versions(spark):
    row = {"source_hash": "sha256:" + "a" * 64, "locale": "de", "config_hash": "sha256:" + "b" * 64, "model_version": "m",
           "text": "x", "cached_at": "2024-01-01T00:00:00.000Z"}
    got, bad = catalogs.parse_cache(docs(
        spark, json.dumps({"version": 3, "entries": [row, row]}), json.dumps({"version": 2, "entries": 5}), json.dumps({"version": 1}),
        json.dumps({"version": 3, "entries": [{**row, "locale": "D"}]}), "nope", json.dumps({"version": 3, "entries": []}) + "]"))
    assert got.count() == 2 and codes(bad) == ["L10N_E0060"] * 3 + ["L10N_E0086"] * 2


def test_sync_state(spark):
    state = {"completed_translations": 1, "total_translations": 4, "status": "running", "started_at": "2024-01-01T00:00:00Z",
             "updated_at": "2024-01-01T00:00:00Z", "config_hash": "c", "source_hash": "s"}
    prints = spark.createDataFrame([(0, "c", "s")], "project int, config_hash string, source_hash string")
    legacy = {k: v for k, v in state.items() if not k.endswith("_hash")}
    kept, bad = catalogs.parse_sync_state(docs(
        spark, json.dumps(state), json.dumps({**state, "source_hash": "t"}), json.dumps(legacy), json.dumps({**state, "total_translations": -1})), prints)
    assert [r.completed_translations for r in kept.collect()] == [1]
    assert codes(bad) == ["L10N_E0069", "L10N_E0080", "L10N_E0080"]


def test_recorded_responses(spark):
    def record(stdout, code=0, stderr=""):
        return {"request": {"sourceLocale": "en", "sourceText": "Hi", "targetLocale": "de"},
                "response": {"exitCode": code, "stdout": stdout, "stderr": stderr}}

    def said(text):
        return json.dumps({"type": "item.completed", "item": {"type": "agent_message", "text": text}}) + "\n"

    text = json.dumps({"records": [record(said("x") + said(json.dumps({"text": "Hallo"}))), record("", 1, "error 429"), record(said("plain")), record("")]})
    got = recorded.parse_recorded_responses(docs(spark, text)).orderBy("response_no").collect()
    assert [(r.text, r.error_code) for r in got] == [("Hallo", None), (None, "L10N_E0053"), (None, "L10N_E0055"), (None, "L10N_E0055")]


# --- jobs ------------------------------------------------------------------------------------
def test_import_makes_reviewed_entries(spark):
    native_rows = spark.createDataFrame([
        (0, "ios", "en", "a", "A {x}", "note", [("x", "number")]), (0, "ios", "de", "a", "A {x} de", None, [("x", "number")]),
        (0, "ios", "es", "a", "A es", None, []), (0, "ios", "fr", "a", " ", None, []), (0, "ios", "de", "b", "B", None, [])], schemas.PLATFORM_ENTRIES)
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    loc = t.locales(spark, ["de", "es", "fr"]).unionByName(t.locales(spark, ["de"], project=7))
    src, ent, bad = applying.import_catalog(native_rows, loc, "xcstrings", now)
    assert [(r.key, r.description) for r in src.collect()] == [("a", "note")]
    assert [(r.locale, r.reviewed, r.provider, r.source_hash) for r in ent.collect()] == [
        ("de", True, "import:xcstrings", src.first().source_hash)]
    assert sorted((r.project, r.code, r.locale) for r in bad.collect()) == [(0, "L10N_E0041", "es"), (7, "L10N_E0010", None)]


def test_renames_are_planned_validated_and_applied(spark):
    src = t.source(spark, [("Home.Title", "T", None, {}), ("tmp.x", "X", None, {}), ("ok.key", "K", None, {})])
    ent = t.entries(spark, src, [("de", "Home.Title", "T", False, True), ("de", "ok.key", "K", False, True)])
    corpus = spark.createDataFrame([(0, "a.ts", 't("Home.Title") t("tmp.x")'), (0, "b.ts", "none")], DOCS)
    done = rename.plan_and_apply_renames(src, ent, t.rules(spark, prefixes=["tmp."]), corpus)
    assert {r.key for r in done.source.collect()} == {"home.title", "x", "ok.key"}
    assert {r.key for r in done.entries.collect()} == {"home.title", "ok.key"}
    assert [(r.path, r.text, r.replacements) for r in done.corpus.collect()] == [("a.ts", 't("home.title") t("x")', 2)]
    assert done.diagnostics.count() == 0
    clash = rename.plan_and_apply_renames(src, ent, t.rules(spark, prefixes=["tmp."]), corpus,
                                          planner=lambda batch: [{"from": r["key"], "to": "ok.key"} for r in batch])
    assert set(codes(clash.diagnostics)) == {"L10N_E0075", "L10N_E0076"} and clash.corpus.count() == 0
    assert {r.key for r in clash.source.collect()} == {"Home.Title", "tmp.x", "ok.key"}


def test_default_plan_cures_depth_and_case(spark):
    rules = t.rules(spark, "snake", 3, [], ["tmp_"])
    candidates = spark.createDataFrame([(0, "tmp_Home.A.b.C9"), (0, "")], "project int, key string")
    got = {r.from_key: (r.to_key, r.skip_reason) for r in plan_renames(candidates, rules).collect()}
    assert got == {"tmp_Home.A.b.C9": ("home_a_c9", None), "": (None, "no other spelling")}


def test_single_rename_and_its_inverse(spark):
    src = t.source(spark, [("a.b", "T", None, {}), ("c.d", "X", None, {})])
    ent = t.entries(spark, src, [("de", "a.b", "T", False, True)])
    s2, e2, found = rename.rename_one(src, ent, t.rules(spark), 0, "a.b", "x.y")
    assert {r.key for r in s2.collect()} == {"x.y", "c.d"} and [r.key for r in e2.collect()] == ["x.y"] and found.count() == 0
    back = renaming.rename_key(s2, 0, "x.y", "a.b")
    assert sorted(r.key for r in back.collect()) == ["a.b", "c.d"]
    for f, to in (("nope", "n.n"), ("a.b", "c.d"), ("a.b", "Bad")):
        s3, _, found = rename.rename_one(src, ent, t.rules(spark), 0, f, to)
        assert found.count() >= 1 and {r.key for r in s3.collect()} == {"a.b", "c.d"}


def torn(left, right):
    return f"<<<<<<< a\n{left}\n=======\n{right}\n>>>>>>> b"


@pytest.mark.parametrize("text,failed,merged", [
    (torn('{"k": {"a": 1}}', '{"k": {"b": [1, 2]}}'), 0, {"k/a": "1", "k/b": "[1,2]"}),
    (torn('{"a": 1}', '{"a": 1.0}'), 0, {"a": "1"}), (torn('{"a": 1}', '{"a": 2}'), 1, {}), (torn("1", "2"), 1, {}),
    (torn('{"a": {}}', '{"a": 5}'), 1, {}), (torn('{"a": 1}', '{"a": '), 1, {}), ('<<<<<<< a\n{}\n=======\n >>>>>>> x', 1, {}),
    ('{"x": [\n' + torn("1", "1") + "\n,\n" + torn("2", "2") + "\n]}", 0, {"x": "[1,2]"}), ('{"a": 1}', 0, {})])
def test_merge(spark, text, failed, merged):
    nodes, found, summary = review.merge_conflicted(docs(spark, text))
    assert found.count() == failed and summary.first().failed == failed
    assert {"/".join(r.path): r.value for r in nodes.filter("kind = 'leaf'").collect()} == merged


def test_merging_a_document_with_itself_changes_nothing(spark):
    doc = json.dumps({"a": {"b": [1, {"c": 2}], "d": None, "e": {}}, "f": "x"})
    flat = merging.flatten_documents(docs(spark, doc), "text", ["project"])
    merged, conflicts = merging.merge_catalogs(flat, flat, ["project"])
    key = lambda df: sorted((tuple(r.path), r.kind, r.value or "") for r in df.collect())
    assert conflicts.count() == 0 and key(merged) == key(flat)


def test_restore(spark):
    files = lambda *r: spark.createDataFrame(list(r), "project int, path string, content string")
    before, after = files((0, "a", "1"), (0, "b", "1")), files((0, "a", "2"), (0, "c", "new"), (0, "b", "1"))
    shot = restoring.snapshot_tables(before, restoring.managed_files(before, after), "h1")
    log = spark.createDataFrame([(0, "h1")], "project int, id string")
    plan, found = sync.restore(shot, after, log, "h1")
    assert {(r.path, r.action) for r in plan.collect()} == {("a", "write"), ("b", "keep"), ("c", "delete")} and found.count() == 0
    assert codes(sync.restore(shot, after, log, "h2")[1]) == ["L10N_E0062"]
    unsafe = shot.unionByName(spark.createDataFrame([("h1", 0, "../x", "y")], shot.schema))
    plan, found = sync.restore(unsafe, after, log, "h1")
    assert plan.count() == 0 and "L10N_E0062" in codes(found)


def test_semantic_groups_are_cleaned(spark):
    from lexilake.operators.dedupe import dedupe_summary, exact_duplicates, normalize_dup_groups

    src = t.source(spark, [(k, x, None, {}) for k, x in [("a", "Save"), ("b", "Save"), ("c", "Store"), ("d", "Keep")]])
    groups = spark.createDataFrame([
        (0, 1, "a", "b", 0.9, "r", "m"), (0, 2, "a", "c", 1.7, " same ", "m"), (0, 2, "a", "zzz", 1.7, " same ", "m"),
        (0, 3, "c", "a", -1.0, "later", "m"), (0, 4, "nope", "a", 0.5, "", "m"), (0, 5, "a", "b", 0.5, "", "m"), (0, 5, "a", "d", 0.5, "", "m")],
        "project int, group_id bigint, canonical_key string, duplicate_key string, confidence double, rationale string, model_version string")
    exact = exact_duplicates(src)
    got = normalize_dup_groups(groups, src, exact)
    assert sorted((r.group_id, r.canonical_key, r.duplicate_key, r.confidence) for r in got.collect()) == [
        (3, "c", "a", 0.0), (5, "a", "b", 0.5), (5, "a", "d", 0.5)]
    s = dedupe_summary(exact, got, src).first()
    assert (s.source_keys, s.exact_groups, s.semantic_groups, s.duplicate_keys) == (4, 1, 2, 2 + 2 + 3)


def test_locales_selected_and_latest_versions(spark):
    chosen, unknown = row_ops.select_locales(t.locales(spark, ["de", "es"]), ["es", "xx", "es"])
    assert [r.locale for r in chosen.collect()] == ["es"] and [(r.code, r.locale) for r in unknown.collect()] == [("L10N_E0069", "xx")]
    assert row_ops.select_locales(t.locales(spark, ["de", "es"]))[0].count() == 2
    versions = spark.createDataFrame([(0, "k", 1, "old"), (0, "k", 3, "new"), (0, "k", 2, "mid")], "project int, key string, at int, text string")
    assert row_ops.latest_entry(versions, ["project", "key"], ["at"]).first().text == "new"


def test_prompt(spark):
    src = t.source(spark, [("a", "Hi {n} {m}", "greeting", {"m": "number"})])
    tasks = spark.createDataFrame([(0, "de", "a", "h")], "project int, locale string, key string, source_hash string")
    terms = spark.createDataFrame([(0, "b", "de", "B"), (0, "a", "de", "A"), (0, "c", "es", "C"), (0, "d", "de", "")], schemas.GLOSSARY)
    prompt = planning.prompt_text(planning.translation_requests(tasks, src, terms)).first().prompt
    assert "Placeholders: n:string, m:number" in prompt and "Terms:\n- a => A\n- b => B\n\nText:\nHi {n} {m}" in prompt
    assert "\n\nUsed for: greeting\n\n" in prompt


def test_archive_names(spark):
    from lexilake.sinks.archive import archive_removed

    import tempfile

    removed = spark.createDataFrame([(p, "de", "k", datetime.datetime(2024, 1, 1)) for p in (1, 2)], "project int, locale string, key string, at timestamp")
    taken = spark.createDataFrame([("de-20240501000000", 0)], "name string, attempt bigint")
    folder = tempfile.mkdtemp(prefix="spark-archive-")
    named = archive_removed(removed, F.expr("timestamp_ntz'2024-05-01 00:00:00'"), taken, folder)
    assert sorted(r.archive_name for r in named.collect()) == ["de-20240501000000-1", "de-20240501000000-2"]
    assert spark.read.parquet(folder).count() == 2
