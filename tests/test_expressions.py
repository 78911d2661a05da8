import hashlib
import json

import pytest
from lexilake.functions import escape, hashing, keys, locales, text, tokens
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()[0]


@pytest.mark.parametrize("a,b,same", [
    ("Hi {name}", "Hallo {name}", True), ("{a} {b}", "{b} {a}", True), ("{0} {1}", "{1} {0}", False),
    ("{a} {a}", "{a}", False), ("{a}", "{b}", False), ("plain", "anders", True), ("{x}", "none", False),
    ("{count, plural, one {#}}", "x", True), ("{a-b.c}", "{a-b.c}!", True), ("{0} {a} {1}", "{a} {0} {1}", True),
])
def test_parity(spark, a, b, same):
    assert one(spark, text.has_parity(F.col("a"), F.col("b")), a=a, b=b) is same
    assert one(spark, text.has_parity(F.col("a"), F.col("a")), a=a) is True


@pytest.mark.parametrize("term,body,found", [
    ("Sign in", "Please Sign in now", True), ("Sign", "Signal", False), ("a.b", "axb", False), ("50%", "a50%b", False),
    ("50%", "50% off", True), (" ", "anything", True), ("ring", "ring", True), ("é", "né", False), ("(x)", "f (x) y", True),
])
def test_contains_term(spark, term, body, found):
    assert one(spark, text.contains_term(F.col("b"), F.col("t")), b=body, t=term) is found


def test_blank_knows_unicode_space(spark):
    assert one(spark, text.is_blank(F.col("a")), a=" ﻿  \n") is True
    assert one(spark, text.is_blank(F.col("a")), a=" x ") is False


def test_source_hash_is_hash_of_canonical_json(spark):
    doc = {"description": 'tab\t"q" \x1f \\ é', "placeholders": {"b": {"type": "number"}, "A": {"example": "x\n", "type": "date"},
           "a_b": {"type": "string"}, "a.b": {"type": "string"}}, "text": "x {b} "}
    ordered = {"A": 1, "a_b": 0, "a.b": 0, "b": 0}
    canonical = {"description": doc["description"],
                 "placeholders": {n: doc["placeholders"][n] for n in ordered}, "text": doc["text"]}
    want = "sha256:" + hashlib.sha256((json.dumps(canonical, indent=2, ensure_ascii=False) + "\n").encode()).hexdigest()
    df = spark.createDataFrame([(doc["text"], doc["description"], {
        n: (p.get("example"), p["type"]) for n, p in doc["placeholders"].items()})],
        "t string, d string, p map<string,struct<example:string,type:string>>")
    # ICU order puts lower case before upper: a_b, a.b, A, b.
    got = df.select(hashing.source_key_json(F.col("t"), F.col("d"), F.col("p"))).first()[0]
    names = list(json.loads(got)["placeholders"])
    assert names.index("a_b") < names.index("a.b") < names.index("b")
    canonical["placeholders"] = {n: doc["placeholders"][n] for n in names}
    want = "sha256:" + hashlib.sha256((json.dumps(canonical, indent=2, ensure_ascii=False) + "\n").encode()).hexdigest()
    assert df.select(hashing.source_hash(F.col("t"), F.col("d"), F.col("p"))).first()[0] == want


def test_empty_placeholders_and_no_description(spark):
    df = spark.createDataFrame([("x", None, {})], "t string, d string, p map<string,struct<example:string,type:string>>")
    want = hashlib.sha256((json.dumps({"placeholders": {}, "text": "x"}, indent=2) + "\n").encode()).hexdigest()
    assert df.select(hashing.source_hash(F.col("t"), F.col("d"), F.col("p"))).first()[0] == "sha256:" + want


@pytest.mark.parametrize("plain,written", [
    ("50% off", "50%% off"), ("%1$s", "%1$s"), ("a & <b>", "a &amp; &lt;b&gt;"), ("@me", "\\@me"), ("a@b?", "a@b?"),
    ("l\nt\t", "l\\nt\\t"), ("it's \"q\" \\", "it\\'s \\\"q\\\" \\\\"), ("?", "\\?"),
])
def test_android_escape(spark, plain, written):
    assert one(spark, escape.android_escape(F.col("a")), a=plain) == written
    assert one(spark, escape.android_decode(F.col("a")), a=written).replace("%%", "%") == plain


@pytest.mark.parametrize("raw,plain", [("a\\\\n", "a\\n"), ("\\x\\", "x\\"), ("&amp;lt;", "&lt;"), ("\\\\\\n", "\\\n")])
def test_android_decode(spark, raw, plain):
    assert one(spark, escape.android_decode(F.col("a")), a=raw) == plain


def test_sequential_and_positional_tokens(spark):
    found = tokens.android_arg_numbers(tokens.android_tokens(F.col("a")))
    assert one(spark, found, a="%s and %3$d and %s %1$s %s") == [1, 3, 4, 1, 6]
    assert one(spark, tokens.ios_arg_numbers(tokens.ios_tokens(F.col("a"))), a="%@ %3$lld %ld %d") == [1, 3, 3, 4]


@pytest.mark.parametrize("locale,ok", [("de", True), ("fil", True), ("zh-Hans-CN", True), ("es-419", True), ("de-de", False),
                                       ("DE", False), ("de\n", False), ("e", False)])
def test_locale(spark, locale, ok):
    assert one(spark, locales.valid_locale(F.col("a")), a=locale) is ok


@pytest.mark.parametrize("folder,locale", [("values", None), ("values-pt-rBR", "pt-BR"), ("values-b+zh+Hans", "zh-Hans"),
                                           ("values-b+sr+Latn+RS", "sr-Latn-RS"), ("values-night", None), ("values-de", "de")])
def test_android_directory(spark, folder, locale):
    assert one(spark, locales.android_locale(F.col("a")), a=folder) == locale


@pytest.mark.parametrize("key,case,ok", [("a.b1", "dotted.lower", True), ("a.b\n", "dotted.lower", False), ("a_b", "snake", True),
                                         ("A_B", "screaming_snake", True), ("a-b", "kebab", True), ("a..b", "dotted.lower", False)])
def test_key_case(spark, key, case, ok):
    assert one(spark, keys.key_matches_case(F.col("k"), F.col("c")), k=key, c=case) is ok


def test_percent(spark):
    pct = hashing.percent_complete(F.col("d"), F.col("t"))
    assert one(spark, pct, d=1, t=3) == 33.3 and one(spark, pct, d=0, t=0) == 100.0 and one(spark, pct, d=9, t=3) == 100.0


def test_fingerprint_ignores_order_and_sees_change(spark):
    rows = [(0, f"k{i}", f"h{i}") for i in range(50)]
    schema = "project int, key string, source_hash string"
    from lexilake.sinks.catalogs import catalog_fingerprint

    prints = {catalog_fingerprint(spark.createDataFrame(r, schema).repartition(5)).first()[1]
              for r in (rows, rows[::-1])}
    assert len(prints) == 1
    rows[7] = (0, "k7", "other")
    assert catalog_fingerprint(spark.createDataFrame(rows, schema)).first()[1] not in prints


@pytest.mark.parametrize("stderr,reason,detail", [
    ("Tool cannot access session files at /u/1429 (permission denied)", "session_files", "/u/1429"),
    ("failed to open state db at /db429: attempt to write a readonly database", "state_database", "/db429"),
    ("x\n  Error: thread/start: no 429  \ny", "thread_start", "Error: thread/start: no 429"),
    ("Error: thread/start: HTTP 429", "rate_limit", None), ("error 429", "rate_limit", None), ("status code: 429", "rate_limit", None),
    ("429", "rate_limit", None), ("took 14290 ms", "exit", None), ("Too Many Requests", "rate_limit", None), ("boom", "exit", None),
])
def test_a_failure_is_not_a_rate_limit_for_a_number_in_its_message(spark, stderr, reason, detail):
    got = one(spark, text.classify_failure(F.col("e"), F.lit("")), e=stderr)
    assert (got["reason"], got["detail"]) == (reason, detail)
