"""Audit, lint, coverage and status jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import has_errors, shape, union_diagnostics
from lexilake.operators.audit import audit_keys, missing_platforms
from lexilake.operators.coverage import locale_coverage, platform_inventory
from lexilake.operators.linting import lint_glossary, lint_keys
from lexilake.operators.planning import estimate_requests, plan_summary, plan_sync, status_summary
from lexilake.operators.rows import history_stats
from lexilake.plans.catalog import Catalog


def audit_catalog(c: Catalog) -> DataFrame:
    """Every finding of a full check: of readers, keys, missing, stale, placeholders, orphans, platforms and their drift."""
    parts = [
        lint_keys(c.source, c.rules),
        audit_keys(c.source, c.entries, c.locales, c.platforms, c.platform_entries, c.source_locale),
    ]
    if c.reader_findings is not None:
        parts.append(shape(c.reader_findings))
    if c.platforms is not None and c.resources is not None:
        parts.append(missing_platforms(c.platforms, c.resources))
    return union_diagnostics(*parts)


def lint_catalog(c: Catalog, glossary: bool = False) -> DataFrame:
    """Key findings, with glossary findings on request."""
    found = lint_keys(c.source, c.rules)
    if glossary and c.glossary is not None:
        found = found.unionByName(lint_glossary(c.source, c.entries, c.glossary))
    return found


def lint_verdict(diags: DataFrame, projects: DataFrame) -> DataFrame:
    """Two flags per project: no finding at all (lint), no error (check)."""
    found = diags.groupBy("project").agg(F.count(F.lit(1)).alias("findings"))
    return projects.select("project").distinct().join(found, "project", "left").join(
        has_errors(diags), "project", "left").select(
        "project", F.coalesce("findings", F.lit(0)).alias("findings"),
        (F.coalesce("findings", F.lit(0)) == 0).alias("lint_ok"), F.coalesce("ok", F.lit(True)).alias("check_ok"))


def coverage_report(c: Catalog) -> dict[str, DataFrame]:
    """Coverage per locale, history, platform inventory and the requests a run would make."""
    tasks = plan_sync(c.source, c.entries, c.locales, c.cache, c.configs)
    report = {
        "locales": locale_coverage(c.source, c.entries, c.locales),
        "requests": estimate_requests(tasks),
    }
    if c.history is not None:
        report["history"] = history_stats(c.history)
    if c.platform_entries is not None:
        report["platforms"] = platform_inventory(c.platform_entries, c.locales)
    return report


def status_report(c: Catalog) -> DataFrame:
    """Plan totals beside the progress of the saved run of each project."""
    return status_summary(plan_summary(c.source, c.entries, c.locales, c.cache, c.configs), c.state)
