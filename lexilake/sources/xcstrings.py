"""String catalogs of one platform: nested JSON maps exploded into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, shape, union_diagnostics
from lexilake.functions.keys import reverse_key
from lexilake.functions.text import contains_plural, unique_placeholders
from lexilake.functions.tokens import IOS_TOKEN, fill_tokens, ios_arg_numbers, ios_tokens, placeholder_type
from lexilake.schemas import PLACEHOLDERS
from lexilake.session import durable
from lexilake.sources.documents import is_object, is_string, once, strict_json
from lexilake.sources.members import DOCUMENT, keyed, of_documents, read_members

LOCALIZATION = (
    "struct<stringUnit:struct<state:string,value:string>,substitutions:map<string,struct<argNum:int,"
    "formatSpecifier:string,variations:map<string,string>>>,variations:map<string,string>>"
)
ENTRY = f"struct<comment:string,localizations:map<string,{LOCALIZATION}>>"
STRINGS = f"struct<strings:map<string,{ENTRY}>>"


def _has(variations, name):
    return F.coalesce(F.try_element_at(variations, F.lit(name)).isNotNull(), F.lit(False))


def ordered_substitutions(substitutions):
    """By argument number, those without one last, then by name."""
    entries = F.coalesce(F.map_entries(substitutions), F.array().cast(
        "array<struct<key:string,value:struct<argNum:int,formatSpecifier:string,variations:map<string,string>>>>"))
    return F.array_sort(F.transform(entries, lambda e: F.struct(
        F.coalesce(e["value"]["argNum"], F.lit(2147483647)).alias("arg"), e["key"].alias("name"),
        e["value"]["formatSpecifier"].alias("spec"), e["value"]["argNum"].alias("given"),
        _has(e["value"]["variations"], "plural").alias("plural"),
        _has(e["value"]["variations"], "device").alias("device"))))


def parse_xcstrings(docs: DataFrame, key_transform: str = "identity") -> tuple[DataFrame, DataFrame]:
    """Platform entries of every catalog.  An entry that cannot be used is reported and left out."""
    v = F.col("v")

    def filled(path):
        return is_string(v, path) & (F.length(F.try_variant_get(v, path, "string")) > 0)

    good = F.coalesce(filled("$.sourceLanguage") & filled("$.version") & is_object(v, "$.strings"), F.lit(False))
    judged = once(once(docs, "v", strict_json(F.col("text"))), "good", good)
    strings = judged.filter("good").select(
        "project", "path", F.explode(F.from_json("text", STRINGS)["strings"]).alias("_key", "_entry"))
    return _platform_rows(strings, judged.filter(~F.col("good")).drop("v", "text"), key_transform)


def xcstrings_members(rows: DataFrame, key_transform: str = "identity") -> tuple[DataFrame, DataFrame]:
    """As ``parse_xcstrings``, of documents given as their members."""
    v = F.col("v")

    def filled(path):
        return is_string(v, path) & (F.length(F.try_variant_get(v, path, "string")) > 0)

    docs = durable(of_documents(
        rows, sourceLanguage=filled("$.sourceLanguage"), version=filled("$.version"), strings=is_object(v, "$.strings")))
    judged = durable(docs.withColumn("good", F.col("good") & F.coalesce(
        F.col("sourceLanguage") & F.col("version") & F.col("strings"), F.lit(False))))
    one = f"struct<e:{ENTRY}>"
    items = durable(keyed(rows, docs, "strings", F.from_json(F.concat(F.lit('{"e":'), F.to_json("_v"), F.lit("}")), one)["e"]))
    strings = items.join(judged.filter("good").select(*DOCUMENT), DOCUMENT).select(
        "project", "path", F.col("key").alias("_key"), F.col("item").alias("_entry"))
    return _platform_rows(strings, judged.filter(~F.col("good")), key_transform)


def xcstrings_versions(rows: DataFrame) -> DataFrame:
    """(project, platform, version) of documents given as their members: the highest version a project has."""
    docs = of_documents(rows, version=F.try_variant_get("v", "$.version", "string"))
    return docs.filter("good").groupBy("project").agg(F.max("version").alias("version")).select(
        "project", F.lit("ios").alias("platform"), "version")


def _platform_rows(strings: DataFrame, bad: DataFrame, key_transform: str) -> tuple[DataFrame, DataFrame]:
    entries = strings.select(
        "project", "path", reverse_key(F.col("_key"), key_transform).alias("key"),
        F.col("_entry.comment").alias("comment"), F.explode("_entry.localizations").alias("locale", "_l"))
    value, subs = F.col("_l.stringUnit.value"), F.col("_subs")
    tokens = entries.withColumn("_subs", ordered_substitutions(F.col("_l.substitutions"))).withColumn(
        "_tokens", ios_tokens(value)).withColumn("_args", ios_arg_numbers(F.col("_tokens")))

    def mapped(arg):
        # Of two substitutions with one number the later in order holds it.
        return F.element_at(F.filter(subs, lambda s: s["given"] == arg), -1)

    plural_unit = F.coalesce(contains_plural(value), F.lit(False))
    variations = F.col("_l.variations")
    error = (
        F.when(plural_unit, "L10N_E0042")
        .when((F.size(subs) > 0) & (_has(variations, "plural") | F.exists(subs, lambda s: s["plural"])), "L10N_E0042")
        .when((F.size(subs) > 0) & (_has(variations, "device") | F.exists(subs, lambda s: s["device"])), "L10N_E0032")
        .when(value.isNull(), "L10N_E0032")
        .when(F.exists(subs, lambda s: F.coalesce(s["given"], F.lit(0)) < 1), "L10N_E0040")
        .when(F.exists("_tokens", lambda t: t.startswith("%#@")), "L10N_E0042")
        .when(F.exists("_args", lambda a: F.size(F.filter(subs, lambda s: s["given"] == a)) == 0), "L10N_E0041"))
    read = once(tokens, "_error", error)
    fine = read.filter(F.col("_error").isNull())
    holders = F.transform("_args", mapped)
    text = F.when(F.size("_tokens") > 0, fill_tokens(value, IOS_TOKEN, F.transform(holders, lambda h: h["name"]))
                  ).otherwise(value)
    # The first token of a placeholder settles its type.
    typed = F.zip_with(holders, F.col("_tokens"), lambda h, t: F.struct(
        h["name"].alias("name"), F.struct(F.lit(None).cast("string").alias("example"),
                                          placeholder_type(h["spec"], t).alias("type")).alias("spec")))
    first = F.filter(typed, lambda p, i: F.array_position(F.transform(typed, lambda q: q["name"]), p["name"]) == i + 1)
    rows = fine.withColumn("_text", text).withColumn("_types", F.map_from_entries(first).cast(PLACEHOLDERS)).select(
        "project", F.lit("ios").alias("platform"), "locale", "key", F.col("_text").alias("text"),
        F.nullif("comment", F.lit("")).alias("comment"),
        unique_placeholders(F.col("_text"), F.col("_types")).alias("placeholders"))
    return rows, union_diagnostics(
        diagnose(bad, "L10N_E0031"),
        shape(read.filter(F.col("_error").isNotNull()).select(
            "project", "path", "locale", "key", F.col("_error").alias("code"), F.lit("error").alias("level"))))


def ingest_xcstrings(spark: SparkSession, path: str, key_transform: str = "identity",
                     **options) -> tuple[DataFrame, DataFrame]:
    """String catalogs of any size below ``path``."""
    return xcstrings_members(read_members(spark, path, **options), key_transform)
