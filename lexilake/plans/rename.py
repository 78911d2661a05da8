"""Rename jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import has_errors, union_diagnostics
from lexilake.operators.linting import lint_keys, rename_candidates, renameable
from lexilake.operators.ranking import batch_candidates
from lexilake.operators.renaming import (
    apply_renames, bulk_reference_rewrite, rename_conflicts, rename_key, validate_renames,
)
from lexilake.providers import plan_renames, plan_renames_with
from lexilake.session import durable


@dataclass(frozen=True)
class RenameResult:
    plan: DataFrame
    source: DataFrame
    entries: DataFrame
    corpus: DataFrame
    diagnostics: DataFrame


def plan_and_apply_renames(source: DataFrame, entries: DataFrame, rules: DataFrame, corpus: DataFrame,
                           planner: Callable | None = None, batch: int = 25) -> RenameResult:
    """Cure key style findings.  Projects whose plan has an error are left as they are."""
    candidates = rename_candidates(renameable(lint_keys(source, rules)), source)
    plan = plan_renames(candidates, rules) if planner is None else plan_renames_with(
        batch_candidates(candidates, batch), planner)
    found = validate_renames(plan, source, rules, candidates)
    blocked = durable(has_errors(found).filter("not ok").select("project"))
    usable = plan.join(blocked, "project", "left_anti")
    return RenameResult(
        plan=plan, source=apply_renames(source, usable), entries=apply_renames(entries, usable),
        corpus=bulk_reference_rewrite(corpus, usable), diagnostics=found)


def rename_one(source: DataFrame, entries: DataFrame, rules: DataFrame, project: int, from_: str,
               to: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rename one key; nothing changes if the request or the resulting catalog has errors."""
    renamed = rename_key(source, project, from_, to)
    found = union_diagnostics(
        rename_conflicts(source, project, from_, to),
        lint_keys(renamed.filter(F.col("project") == project), rules))
    blocked = durable(has_errors(found).filter("not ok").select("project"))

    def gated(before: DataFrame, after: DataFrame) -> DataFrame:
        return after.join(blocked, "project", "left_anti").unionByName(before.join(blocked, "project", "left_semi"))

    return gated(source, renamed), gated(entries, rename_key(entries, project, from_, to)), found
