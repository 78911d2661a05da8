"""The one row shape that every check writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARNINGS = {"L10N_E0070", "L10N_E0071", "L10N_E0078", "L10N_E0080", "L10N_E0083", "L10N_E0086", "L10N_E0090"}
COLUMNS = ["project", "code", "level", "locale", "key", "path", "details"]


def level_of(code: str) -> str:
    return "warn" if code in WARNINGS else "error"


def details_map(details: dict[str, Column] | None) -> Column:
    if not details:
        return F.lit(None).cast("map<string,string>")
    pairs = [item for name, value in details.items() for item in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def finding(code: str, details: dict[str, Column] | None = None) -> Column:
    """One diagnostic as a struct, for arrays of findings about the same row."""
    return F.struct(F.lit(code).alias("code"), F.lit(level_of(code)).alias("level"),
                    details_map(details).alias("details"))


def diagnose(df: DataFrame, code: str, details: dict[str, Column] | None = None) -> DataFrame:
    """One diagnostic per row of ``df``; columns the frame lacks become NULL."""
    return shape(df.select(
        *[F.col(c) for c in ("project", "locale", "key", "path") if c in df.columns],
        F.lit(code).alias("code"), F.lit(level_of(code)).alias("level"), details_map(details).alias("details")))


def explode_findings(df: DataFrame, *findings: Column) -> DataFrame:
    """Spread the non-null findings of each row, reading the row once however many fire."""
    found = F.filter(F.array(*findings), lambda f: f.isNotNull())
    kept = [F.col(c) for c in ("project", "locale", "key", "path") if c in df.columns]
    return shape(df.select(*kept, F.explode(found).alias("f")).select(
        *kept, "f.code", "f.level", "f.details"))


def shape(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    kinds = {"project": "int", "details": "map<string,string>"}
    return df.select(*[
        (F.col(c) if c in present else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def union_diagnostics(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def has_errors(diags: DataFrame) -> DataFrame:
    """Per project: may writes go ahead?"""
    return diags.groupBy("project").agg((~F.bool_or(F.col("level") == "error")).alias("ok"))


def check_summary(diags: DataFrame) -> DataFrame:
    """Findings per code; the per-project gate is :func:`has_errors`."""
    return diags.groupBy("project", "code", "level").agg(F.count(F.lit(1)).alias("n"))


def check_totals(source: DataFrame, locales: DataFrame, diags: DataFrame) -> DataFrame:
    """Per project: its keys, the target locales that a check covers, and whether it may be written."""
    keys = source.groupBy("project").agg(F.count(F.lit(1)).alias("source_keys"))
    checked = locales.filter(~F.col("is_source")).groupBy("project").agg(F.count_distinct("locale").alias("locales_checked"))
    return keys.join(checked, "project", "full_outer").join(has_errors(diags), "project", "left").select(
        "project", F.coalesce("source_keys", F.lit(0)).alias("source_keys"),
        F.coalesce("locales_checked", F.lit(0)).alias("locales_checked"), F.coalesce("ok", F.lit(True)).alias("ok"))
