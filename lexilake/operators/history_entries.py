"""Rows of the history log, one function for each operation.

Each takes a frame with ``project`` and ``at`` (when it happened), makes ids of the time and a suffix, and adds the
fields that its operation has.  Fields may be columns or values.  ``append_history`` writes what they return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexilake.functions.hashing import history_id
from lexilake.schemas import HISTORY
from lexilake.sinks.catalogs import iso_instant


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _entry(rows: DataFrame, op: str, actor, suffix, **fields) -> DataFrame:
    """(project, id, op, actor, ts, …): every field of the log, null where the operation has none."""
    made = {"id": history_id(F.col("at"), _column(suffix)), "op": F.lit(op), "actor": _column(actor), "ts": iso_instant(F.col("at")),
            **{name: _column(value) for name, value in fields.items()}}
    return rows.select("project", *[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(HISTORY)])


def init_entry(rows: DataFrame, actor, summary) -> DataFrame:
    return _entry(rows, "init", actor, "init", summary=summary)


def sync_entry(rows: DataFrame, actor, summary) -> DataFrame:
    return _entry(rows, "sync", actor, "sync", summary=summary)


def import_entry(rows: DataFrame, actor, origin, summary) -> DataFrame:
    return _entry(rows, "import", actor, "import", **{"from": origin, "summary": summary})


def rename_entry(rows: DataFrame, actor, before, after) -> DataFrame:
    return _entry(rows, "rename", actor, "rename", before=before, after=after)


def lint_fix_entry(rows: DataFrame, actor, renames, files_updated) -> DataFrame:
    """``renames`` is an array of structs of ``before`` and ``after``."""
    return _entry(rows, "lint_fix", actor, "lint-fix", renames=renames, files_updated=files_updated)


def rollback_entry(rows: DataFrame, actor, to) -> DataFrame:
    return _entry(rows, "rollback", actor, "rollback", to=to)


def delete_entry(rows: DataFrame, actor, key) -> DataFrame:
    return _entry(rows, "delete", actor, "delete", key=key)


def add_locale_entry(rows: DataFrame, actor, locale) -> DataFrame:
    return _entry(rows, "add_locale", actor, "add-locale", locale=locale)


def remove_locale_entry(rows: DataFrame, actor, locale) -> DataFrame:
    return _entry(rows, "remove_locale", actor, "remove-locale", locale=locale)


def repair_entry(rows: DataFrame, actor, summary) -> DataFrame:
    return _entry(rows, "repair", actor, "repair", summary=summary)
