"""The registry that pairs each query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.views import Lake, with_views

QUERIES: dict[str, Callable[[Lake], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **extra: str):
    """Register a query; ``extra`` are further common table expressions its SQL uses."""
    def add(fn: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn

    return add


def flat(diags: DataFrame, *columns: str) -> DataFrame:
    """Diagnostics with their details as one sorted ``name=value;…`` string."""
    pairs = F.transform(F.map_entries("details"), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    kept = columns or ("project", "code", "level", "locale", "key")
    return diags.select(*kept, F.coalesce(F.array_join(F.array_sort(pairs), ";"), F.lit("")).alias("details"))
