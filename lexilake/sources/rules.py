"""Project configuration as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, explode_findings, finding
from lexilake.functions.escape import json_string
from lexilake.functions.keys import CASE_PATTERNS, TRANSFORM_SEPARATORS
from lexilake.functions.locales import valid_locale

CONFIG = (
    "project int, source_locale string, target_locales array<string>, key_case string, max_depth int, "
    "scopes array<string>, forbidden_prefixes array<string>, platforms map<string,struct<path:string,"
    "key_transform:string>>, glossary map<string,map<string,string>>, provider_type string, model string"
)


def project_rules(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rules, locales, platforms and glossary of valid configurations, and findings for the rest."""
    empty = F.array().cast("array<string>")
    filled = rows.withColumns({
        "key_case": F.coalesce("key_case", F.lit("dotted.lower")),
        "max_depth": F.coalesce("max_depth", F.lit(4)),
        "scopes": F.coalesce("scopes", empty),
        "forbidden_prefixes": F.coalesce("forbidden_prefixes", empty),
        "target_locales": F.coalesce("target_locales", empty),
    })
    platforms = F.coalesce(F.map_values("platforms"), F.array())
    transform_ok = lambda p: F.coalesce(p["key_transform"], F.lit("identity")).isin(*TRANSFORM_SEPARATORS)
    problems = {
        "key_case": ~F.col("key_case").isin(*CASE_PATTERNS),
        "max_depth": ~F.col("max_depth").between(1, 10),
        "source_locale": ~valid_locale(F.coalesce("source_locale", F.lit(""))),
        "target_locales": (F.size("target_locales") == 0)
        | F.exists("target_locales", lambda l: ~valid_locale(l))
        | F.array_contains("target_locales", F.col("source_locale")),
        "platforms": (F.size(platforms) <= 0) | ~F.coalesce(F.forall("platforms_list", transform_ok), F.lit(True)),
    }
    judged = filled.withColumn("platforms_list", platforms)
    judged = judged.withColumn("failed", F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in problems.items()]),
        lambda f: f.isNotNull()))
    good = judged.filter(F.size("failed") == 0)
    rules = good.select("project", "key_case", "max_depth", "scopes", "forbidden_prefixes")
    locales = good.select("project", F.col("source_locale").alias("locale"), F.lit(True).alias("is_source")).unionByName(
        good.select("project", F.explode(F.array_distinct("target_locales")).alias("locale"),
                    F.lit(False).alias("is_source")))
    targets = good.select("project", F.explode("platforms").alias("platform", "p")).select(
        "project", "platform", F.col("p.path").alias("path"),
        F.coalesce("p.key_transform", F.lit("identity")).alias("key_transform"))
    glossary = good.select("project", F.explode("glossary").alias("source_term", "t")).select(
        "project", "source_term", F.explode("t").alias("locale", "target_term"))
    bad = explode_findings(
        judged.filter(F.size("failed") > 0).select("project", F.explode("failed").alias("field")),
        finding("L10N_E0003", {"field": F.col("field")}))
    return rules, locales, targets, glossary, bad


def config_hashes(rows: DataFrame, minimum: str | None = None) -> DataFrame:
    """Hash of the settings that change a translation: provider type, model, glossary and a least provider version.

    It is that of their canonical JSON document.  ``minimum`` is the name that the least
    version has in the document and its column; without one the document has no such member.  A model that is not set
    is no member either.
    """
    glossary = F.coalesce("glossary", F.create_map().cast("map<string,map<string,string>>"))
    named = [("type", json_string(F.col("provider_type"))), ("model", json_string(F.col("model"))),
             ("glossary", stable_map(glossary, lambda terms, indent: stable_map(terms, lambda v, _: json_string(v), indent), 1)),
             *([(minimum, json_string(F.col(minimum)))] if minimum else [])]
    return rows.select("project", F.concat(F.lit("sha256:"), F.sha2(F.concat(
        stable_object(named), F.lit("\n")).cast("binary"), 256)).alias("config_hash"))


def stable_object(named: list[tuple[str, Column]]) -> Column:
    """A JSON object of members that are JSON texts, in order of their names; null members are left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f'  "{name}": '), value)) for name, value in sorted(named)]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def stable_map(values: Column, render, indent: int) -> Column:
    """A map as a JSON object in ICU order of its keys; ``render`` makes the text of a value at a depth."""
    pad = "  " * (indent + 1)
    names = F.array_sort(F.transform(F.map_keys(values), lambda k: F.struct(F.collate(k, "UNICODE").alias("order"), k.alias("key"))))
    lines = F.transform(names, lambda e: F.concat(
        F.lit(pad), json_string(e["key"]), F.lit(": "), render(F.element_at(values, e["key"]), indent + 1)))
    return F.when(F.size(values) == 0, "{}").otherwise(
        F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n" + "  " * indent + "}")))
