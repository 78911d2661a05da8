"""A set of projects as one value, so that jobs take one argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Catalog:
    """The tables of a lake of projects; every one has a ``project`` column.

    ``reader_findings`` are those of the readers that made the tables, which audits repeat and runs heed;
    ``resources`` (project, platform) are the platforms whose files are there.
    """

    source: DataFrame
    entries: DataFrame
    locales: DataFrame
    rules: DataFrame
    configs: DataFrame
    cache: DataFrame
    glossary: DataFrame | None = None
    platforms: DataFrame | None = None
    platform_entries: DataFrame | None = None
    history: DataFrame | None = None
    state: DataFrame | None = None
    reader_findings: DataFrame | None = None
    resources: DataFrame | None = None
    source_locale: str = "en"
