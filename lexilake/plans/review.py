"""Duplicate copy and catalog merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import union_diagnostics
from lexilake.operators.dedupe import (
    dedupe_summary, exact_duplicates, exact_findings, normalize_dup_groups, semantic_findings,
)
from lexilake.operators.merging import (
    flatten_documents, judged_sections, merge_catalogs, merge_findings, merge_summary,
)
from lexilake.operators.near import near_duplicates
from lexilake.operators.rendering import render_documents
from lexilake.session import durable, shuffled


def suggested_groups(near: DataFrame, model_version: str = "minhash") -> DataFrame:
    """Near-duplicate members in the shape of suggested groups."""
    return near.select(
        "project", F.xxhash64("canonical_key").alias("group_id"), "canonical_key", "duplicate_key", "confidence",
        F.lit("near-identical wording").alias("rationale"), F.lit(model_version).alias("model_version"))


def dedupe_report(source: DataFrame, threshold: float = 0.7,
                  groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact members, cleaned groups, counts and findings.  ``groups`` replaces the measured ones."""
    exact = exact_duplicates(source)
    suggested = groups if groups is not None else suggested_groups(near_duplicates(source, threshold))
    cleaned = normalize_dup_groups(suggested, source, exact)
    return exact, cleaned, dedupe_summary(exact, cleaned, source), union_diagnostics(
        exact_findings(exact), semantic_findings(cleaned))


def merge_conflicted(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged nodes of every conflicted document, findings and counts.

    ``files`` has project, path (unique in its project) and text.
    """
    return _merged(files)[:3]


def _merged(files: DataFrame):
    sections = judged_sections(files)
    torn = sections.filter("conflicted and not malformed and parses").withColumnRenamed("path", "doc")
    merged, conflicts = merge_catalogs(
        flatten_documents(torn, "left", ["project", "doc"]),
        flatten_documents(torn, "right", ["project", "doc"]), ["project", "doc"])
    conflicts = conflicts.withColumnRenamed("doc", "path")
    return merged, merge_findings(sections, conflicts), merge_summary(sections, conflicts), sections, conflicts


def repair_documents(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents to rewrite (project, path, text), findings and counts.

    Conflicted documents are merged, all are brought to canonical form, and those that are in it already are left
    out.  A document that cannot be merged or read stays as it is, with a finding.
    """
    merged, found, _, sections, conflicts = _merged(files)
    plain = sections.filter("not conflicted and parses").withColumnRenamed("path", "doc")
    nodes = merged.unionByName(flatten_documents(plain, "left", ["project", "doc"]))
    texts = durable(render_documents(nodes, ["project", "doc"]).withColumnRenamed("doc", "path"))
    rewritten = durable(texts.join(shuffled(files.select("project", "path", F.col("text").alias("_was"))), ["project", "path"]).filter(
        F.col("text") != F.col("_was")).drop("_was"))
    return rewritten, found, merge_summary(sections, conflicts, rewritten)
