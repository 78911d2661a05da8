import dataclasses
import datetime
import json

from lexilake import schemas
from lexilake.operators import audit, cache, linting, planning, rows as row_ops
from lexilake.plans import audit as audit_plan, sync
from lexilake.plans.catalog import Catalog
from pyspark.sql import functions as F

import rows as t

def now():
    return F.expr("timestamp_ntz'2024-06-01 00:00:00'")


def project(spark, src, ent, names=("de", "es"), **kw):
    return Catalog(source=src, entries=ent, locales=t.locales(spark, names), rules=kw.pop("rules", t.rules(spark)),
                   configs=t.configs(spark), cache=kw.pop("cache", t.empty(spark, schemas.CACHE)), **kw)


def codes(df):
    return sorted(r.code for r in df.collect())


def test_broken_project_reports_each_problem(spark):
    src = t.source(spark, [("tmp.old", "Old", None, {}), ("Home.Very.Deep", "Deep", None, {}), ("other.x", "X {a}", None, {"a": "string"}),
                           ("home.items", "{n, plural, one {#} other {#}}", None, {})])
    ent = t.entries(spark, src, [("de", "tmp.old", "Alt", False, False), ("de", "gone", "weg", True, True), ("de", "other.x", "X", False, True)])
    c = project(spark, src, ent, rules=t.rules(spark, depth=2, scopes=["home", "tmp"], prefixes=["tmp."]))
    found = codes(audit_plan.audit_catalog(c))
    for code in ("20", "21", "22", "23", "41", "42", "61", "63", "64", "65"):
        assert f"L10N_E00{code}" in found, code
    assert codes(linting.lint_keys(src, c.rules)).count("L10N_E0022") == 2


def test_healthy_project_is_clean(spark):
    src = t.source(spark, [("home.title", "Hello {name}", "greets", {"name": "string"})])
    ent = t.entries(spark, src, [(loc, "home.title", "x {name}", True, True) for loc in ("de", "es")])
    assert audit_plan.audit_catalog(project(spark, src, ent)).count() == 0


def test_reader_findings_and_missing_platforms_are_reported(spark):
    src = t.source(spark, [("home.title", "Hello", None, {})])
    ent = t.entries(spark, src, [(loc, "home.title", "x", True, True) for loc in ("de", "es")])
    found = spark.createDataFrame([(0, "L10N_E0011", "error", "a.json")], "project int, code string, level string, path string")
    platforms = spark.createDataFrame([(0, "ios"), (0, "android")], "project int, platform string")
    c = project(spark, src, ent, reader_findings=found, platforms=platforms, resources=platforms.limit(1))
    assert codes(audit_plan.audit_catalog(c)) == ["L10N_E0011", "L10N_E0030"]


def test_glossary_needs_whole_words(spark):
    src = t.source(spark, [("a", "Open the Board", None, {}), ("b", "Boarding pass", None, {}), ("c", "100% Board-free", None, {})])
    ent = t.entries(spark, src, [("de", k, x, False, True) for k, x in [("a", "Tafeln"), ("b", "x"), ("c", "Tafel: x")]])
    terms = spark.createDataFrame([(0, "Board", "de", "Tafel"), (0, "%", "de", "Prozent"), (0, "", "de", "Leer"),
                                   (0, "the Board", "de", "")], schemas.GLOSSARY)
    got = {(r.key, r.details["source_term"]) for r in linting.lint_glossary(src, ent, terms).collect()}
    assert got == {("a", "Board"), ("c", "%"), ("a", ""), ("b", ""), ("c", "")}


def cache_row(spark, src, key, locale, text, day, model="m1"):
    h = src.filter(F.col("key") == key).first().source_hash
    return (0, h, locale, "sha256:" + "c" * 64, model, text, datetime.datetime(2024, 1, day))


def responses(spark, rows):
    return spark.createDataFrame([("en", loc, src, i, txt, "r", err) for i, (loc, src, txt, err) in enumerate(rows)],
                                 "source_locale string, locale string, source_text string, response_no bigint, text string, "
                                 "model_version string, error_code string")


def test_sync_applies_and_then_has_nothing_left_to_do(spark):
    src = t.source(spark, [("a", "A {x}", None, {"x": "string"}), ("b", "B", None, {}), ("c", "C {x}", None, {"x": "string"})])
    ent = t.entries(spark, src, [("de", "b", "B alt", False, False), ("de", "gone", "weg", True, True), ("es", "b", "B es", True, False)])
    hits = spark.createDataFrame([cache_row(spark, src, "a", "de", "A kein", 1), cache_row(spark, src, "a", "de", "A neu", 2, "m0")], schemas.CACHE)
    c = project(spark, src, ent, cache=hits)
    answers = responses(spark, [("de", "B", "B neu", None), ("de", "B", "later", None), ("de", "C {x}", "C", None), ("es", "A {x}", "A {x} es", None),
                                ("es", "C {x}", None, "L10N_E0053")])
    done = sync.apply_sync(c, answers, "recorded", now())
    got = {(r.locale, r.key): (r.text, r.stale, r.model_version) for r in done.entries.collect()}
    assert got == {("de", "a"): ("A neu", False, "m0"), ("de", "b"): ("B neu", False, "r"), ("es", "a"): ("A {x} es", False, "r"),
                   ("es", "b"): ("B es", True, "m")}
    assert codes(done.diagnostics) == ["L10N_E0041", "L10N_E0053", "L10N_E0083", "L10N_E0090"]
    assert [(r.key, r.reason, r.archive_name) for r in done.archive.collect()] == [("gone", "key", "de-20240601000000")]
    # Two rows for a@de stay, one row each was added for b@de and a@es.
    assert done.cache.count() == 4
    again = planning.plan_sync(src, done.entries, c.locales, done.cache, c.configs)
    assert {(r.locale, r.key) for r in again.collect()} == {("de", "c"), ("es", "c")}
    strict = sync.apply_sync(c, answers, "recorded", now(), strict=True)
    assert {(r.locale, r.key) for r in strict.entries.collect()} == {("de", "b"), ("es", "b")}


def test_errors_hold_a_project_back(spark):
    src = t.source(spark, [("a", "A {x}", None, {"x": "string"})])
    ent = t.entries(spark, src, [("de", "a", "A", True, False)])
    done = sync.apply_sync(project(spark, src, ent), responses(spark, [("es", "A {x}", "A {x}", None)]), "r", now())
    assert done.entries.count() == 1 and codes(done.diagnostics) == ["L10N_E0082"]


def test_sync_loses_nothing(spark):
    src = t.source(spark, [("a", "A", None, {})])
    ent = t.entries(spark, src, [("de", "a", "A de", True, True), ("fr", "a", "A fr", True, True), ("fr", "old", "x", False, True),
                                 ("de", "gone", "weg", True, True), ("de", "tmp", "weg", False, True)])
    dead = spark.createDataFrame([(0, "sha256:dead", "de", "c", "m", "x", datetime.datetime(2024, 1, 9))], schemas.CACHE)
    c = project(spark, src, ent, names=("de",), cache=dead)
    none = responses(spark, [("xx", "x", "x", None)])
    done = sync.apply_sync(c, none, "r", now())
    at = lambda df: sorted((r.locale, r.key) for r in df.collect())
    assert at(done.entries) == [("de", "a")] and at(done.removed) == [("de", "tmp")]
    assert at(done.archive) == [("de", "gone"), ("fr", "a"), ("fr", "old")]
    assert sorted((r.op, r.locale, r.entries) for r in done.history.collect()) == [("archive_entries", "de", 1), ("remove_locale", "fr", 2)]
    # A project that is held back keeps all it had, whatever the locale, and its cache.
    bad = t.entries(spark, t.source(spark, [("a", "other", None, {})]), [("fr", "a", "A", True, False)]).unionByName(
        t.entries(spark, t.source(spark, [("a", "A {x}", None, {"x": "string"})]), [("de", "a", "A", True, True)]))
    held = sync.apply_sync(project(spark, t.source(spark, [("a", "A {x}", None, {"x": "string"})]), bad, names=("de",), cache=dead), none, "r", now())
    assert at(held.entries) == [("de", "a"), ("fr", "a")] and held.cache.count() == 1
    assert held.archive.count() == held.removed.count() == held.history.count() == 0


def test_cache_upsert_and_gc(spark):
    src = t.source(spark, [("a", "A", None, {})])
    old = spark.createDataFrame([cache_row(spark, src, "a", "de", f"t{d}", d, f"m{d}") for d in range(1, 6)], schemas.CACHE)
    dead = spark.createDataFrame([(0, "sha256:dead", "de", "c", "m", "x", datetime.datetime(2024, 1, 9))], schemas.CACHE)
    new = spark.createDataFrame([cache_row(spark, src, "a", "de", "new", 30, "m1")], schemas.CACHE)
    once = cache.upsert_cache(old.unionByName(dead), new)
    twice = cache.upsert_cache(once, new)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert once.count() == 6 and key(once) == key(twice)
    kept = cache.gc_cache(once, src)
    assert sorted(r.text for r in kept.collect()) == ["new", "t5"]
    assert key(cache.gc_cache(kept, src)) == key(kept)


def test_stale_flags(spark):
    src = t.source(spark, [("a", "A", None, {}), ("b", "B", None, {})])
    ent = t.entries(spark, src, [("de", "a", "x", True, False), ("de", "b", "y", True, True), ("de", "z", "z", True, True)])
    ent = ent.withColumn("stale", F.col("key") == "b")
    got = {r.key: (r.stale, r.changed) for r in row_ops.refresh_stale_flags(ent, src).collect()}
    assert got == {"a": (True, True), "b": (False, True), "z": (False, False)}


def test_drift_reports_both_text_and_placeholders(spark):
    src = t.source(spark, [("a", "A {x}", None, {"x": "number"}), ("b", "B", None, {"unused": "date"}), ("c", "C", None, {})])
    actual = spark.createDataFrame([
        (0, "ios", "en", "a", "A! {x}", None, [("x", "string")]), (0, "ios", "en", "b", "B", None, []),
        (0, "ios", "en", "extra", "E", None, [])], schemas.PLATFORM_ENTRIES)
    platforms = spark.createDataFrame([(0, "ios")], "project int, platform string")
    expected = audit.expected_platform(src, t.empty(spark, schemas.ENTRIES), platforms)
    got = sorted((r.key, r.code[-4:]) for r in audit.platform_drift(expected, actual).collect())
    assert got == [
        ("a", "0041"), ("a", "0067"), ("b", "0041"), ("c", "0066"), ("extra", "0068")]


def test_written_catalog_is_canonical_json(spark, tmp_path):
    from lexilake.sinks.catalogs import write_catalogs, write_sources
    from lexilake.sources.catalogs import parse_source_catalogs, parse_translations, read_translations

    src = t.source(spark, [(k, f"text {k} \"q\"", None if k == "b" else "d", {"n": "number"}) for k in ("b", "a.b", "a_b", "A", "ab")])
    ent = t.entries(spark, src, [("de", k, "x\ny", True, True) for k in ("b", "a.b", "a_b", "A", "ab")] + [("es", "a.b", "s", False, False)])
    write_catalogs(ent, str(tmp_path / "t"))
    write_sources(src, str(tmp_path / "s"))

    def document(folder):
        parts = sorted(folder.glob("part=*"), key=lambda p: int(p.name[5:]))
        return "".join(f.read_text() for p in parts for f in p.glob("part-*"))

    de = document(tmp_path / "t" / "project=0" / "locale=de")
    loaded = json.loads(de)
    assert de == json.dumps(loaded, indent=2, ensure_ascii=False) + "\n"
    assert list(loaded["entries"]) == ["a_b", "a.b", "A", "ab", "b"] or list(loaded["entries"]) == ["A", "a_b", "a.b", "ab", "b"]
    es = document(tmp_path / "t" / "project=0" / "locale=es")
    # The same text in more parts, which are read as one document, and not without one of them or with one cut.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_catalogs(ent, str(tmp_path / "w"), parts=6)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "w" / "project=0" / "locale=de").glob("part=*/part-*"))
    assert len(parts) > 1 and document(tmp_path / "w" / "project=0" / "locale=de") == de
    assert document(tmp_path / "w" / "project=0" / "locale=es") == es
    rows, bad = read_translations(spark, str(tmp_path / "w"))
    assert rows.count() == 6 and bad.count() == 0
    body = parts[0].read_text()
    parts[0].write_text(body[:-1])
    parts[0].with_name(f".{parts[0].name}.crc").unlink()
    for change in (lambda: None, parts[0].unlink):
        change()
        rows, bad = read_translations(spark, str(tmp_path / "w"))
        assert {r.locale for r in rows.collect()} == {"es"} and [r.code for r in bad.collect()] == ["L10N_E0011"]
    docs = spark.createDataFrame([(0, "de", de), (0, "es", es), (0, "bad", de + "x")], "project int, path string, text string")
    rows, bad = parse_translations(docs)
    assert rows.count() == 6 and [r.path for r in bad.collect()] == ["bad"]
    en = document(tmp_path / "s" / "project=0" / "locale=en")
    assert en == json.dumps(json.loads(en), indent=2, ensure_ascii=False) + "\n"
    back, _ = parse_source_catalogs(spark.createDataFrame([(0, "en", en)], "project int, path string, text string"))
    assert {r.key: r.source_hash for r in back.collect()} == {r.key: r.source_hash for r in src.collect()}


def test_catalog_files_are_read_back(spark, tmp_path):
    from lexilake.sinks.catalogs import write_sources
    from lexilake.sources.catalogs import read_source_catalogs
    from lexilake.sources.corpus import scan_text_corpus
    from lexilake.sources.history import read_history

    src = t.source(spark, [("a.b", "A\nB", "d", {})])
    write_sources(src, str(tmp_path / "s"))
    rows, bad = read_source_catalogs(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in src.select(rows.columns).collect()] and bad.count() == 0
    for name, body in {"src/a.ts": "x", "src/b.bin": "x", "node_modules/c.ts": "x", "l10n/d.json": "x", "e.XML": "a\x00b", "f.yml": "ok"}.items():
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_text(body)
    found = scan_text_corpus(spark, str(tmp_path / "c"), catalog_dir="l10n").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.ts", "f.yml"]
    log = tmp_path / "history.jsonl"
    log.write_text('{"id": "1", "op": "init", "actor": "a", "ts": "2024-01-01T00:00:00Z", "summary": "s"}\n')
    assert [(r.line_no, r.op) for r in read_history(spark, str(log))[0].collect()] == [(1, "init")]


def test_status_dataclass_is_replaceable(spark):
    src = t.source(spark, [("a", "A", None, {})])
    c = project(spark, src, t.empty(spark, schemas.ENTRIES))
    assert dataclasses.replace(c, source_locale="fr").source_locale == "fr"
    assert planning.plan_summary(c.source, c.entries, c.locales, c.cache, c.configs).filter("locale is null").first().pending == 2


def test_a_repeated_member_counts_with_its_last_value(spark, tmp_path):
    from lexilake.sources import catalogs

    (tmp_path / "source.en.json").write_text('{"version":1,"keys":{"a":{"text":"one"},"b":{"text":"B"},"a":{"text":"two"}}}')
    rows, found = catalogs.read_source_catalogs(spark, str(tmp_path))
    assert {(r.key, r.text) for r in rows.collect()} == {("a", "two"), ("b", "B")} and found.count() == 0


def test_documents_are_parsed_once_for_rows_and_findings(spark):
    """Rows and findings read one stored table, and a document is parsed at one place of the plan."""
    from lexilake.sources import catalogs, history
    from lexilake.sources.documents import parse_once, strict_json

    docs = spark.createDataFrame([
        (0, "a", '{"version": 1, "locale": "de", "entries": {"k": {"text": "t", "model_version": "m", "provider": "p", "source_hash": "sha256:'
         + "0" * 64 + '", "translated_at": "2024-01-01T00:00:00Z"}}}'), (0, "b", "{")], "project int, path string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for parse, good in ((catalogs.parse_translations, 1), (catalogs.parse_cache, 0), (catalogs.parse_source_catalogs, 0), (history.parse_snapshots, 0)):
        rows, bad = parse(docs)
        assert "parseJson" not in plan(rows) and "parseJson" not in plan(bad)
        assert (rows.count(), bad.count()) == (good, 2 - good)
    texts = spark.createDataFrame([('{"a": 1}',), ('{"a": 1} 2',), ("[1",), ("",), (None,)], "text string")
    for df in (parse_once(texts, "v", texts.text), texts.withColumn("v", strict_json(texts.text))):
        assert [r.good for r in df.selectExpr("v IS NOT NULL AS good").collect()] == [True, False, False, False, False]
        assert plan(df).count("parseJson") == 1


def test_lines_of_documents_end_at_the_last_that_is_not_empty(spark):
    from lexilake.sources.history import document_lines, is_last_line

    docs = spark.createDataFrame([(0, "a", "x\n\ny\n\n"), (0, "b", "\n\n"), (0, "c", ""), (0, "d", "z"), (0, "e", None), (0, "f", "x\n \n")],
                                 "project int, path string, text string")
    lines = document_lines(docs)
    want = {("a", 1, "x", False), ("a", 2, "", False), ("a", 3, "y", True), ("d", 1, "z", True), ("f", 1, "x", False), ("f", 2, " ", True)}
    assert {(r.path, r.line_no, r.line, r.is_last) for r in lines.collect()} == want
    again = is_last_line(lines.drop("is_last"))
    assert {(r.path, r.line_no, r.line, r.is_last) for r in again.collect()} == want


def test_a_snapshot_makes_its_files_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexilake.sinks import snapshots

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(path):
        made.add(1)
        return None if path == "c" else "same"

    files = spark.createDataFrame([("h", 0, p) for p in "abc"], "history_id string, project int, path string").withColumn("content", content("path"))
    for _ in range(2):
        snapshots.write_snapshot(files, str(tmp_path))
    assert made.value == 6
    assert [r.content for r in snapshots.read_snapshot(spark, str(tmp_path), "h").orderBy("path").collect()] == ["same", "same", None]
    assert snapshots.read_blobs(spark, str(tmp_path)).count() == 1
