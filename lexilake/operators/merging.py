"""Three-file git conflicts in catalogs: split the sides, merge them leaf by leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, union_diagnostics
from lexilake.operators.rendering import expand_objects, leaf_json
from lexilake.session import durable, shuffled
from lexilake.sources.documents import strict_json, take_repeated_members

# One conflict block: an opening line, a line of seven equal signs, a closing line.
_BLOCK = r"(?md)^<<<<<<< [^\n]*\n([\s\S]*?)^=======\n([\s\S]*?)^>>>>>>> [^\n]*(?:\n|\z)"


def conflict_sections(files: DataFrame) -> DataFrame:
    """Add ``conflicted``, ``malformed`` and the two sides of each file's text.

    A file without markers has both sides equal to its text.  One with an unfinished block is
    malformed and has none.
    """
    text = F.col("text")
    marked = text.contains("<<<<<<< ") & text.contains("=======") & text.contains(">>>>>>> ")
    left_over = F.regexp_replace(text, _BLOCK, "")
    blocks = text.rlike(_BLOCK)
    malformed = marked & (left_over.rlike(r"(?md)^<<<<<<< ") | ~blocks)
    ends_in_block = text.rlike(r"(?md)^>>>>>>> [^\n]*\z")

    def side(group: str):
        kept = F.regexp_replace(text, _BLOCK, group)
        kept = F.when(ends_in_block, F.regexp_replace(kept, r"\n\z", "")).otherwise(kept)
        return F.when(malformed, F.lit(None)).when(marked, kept).otherwise(text)

    return files.withColumns({
        "conflicted": marked, "malformed": malformed, "left": side("$1"), "right": side("$2")})


def judged_sections(files: DataFrame) -> DataFrame:
    """:func:`conflict_sections` with ``parses`` (both sides are JSON), stored once for all its readers."""
    take_repeated_members(files.sparkSession)
    sections = durable(conflict_sections(files).drop("text"))
    parses = strict_json(F.col("left")).isNotNull() & strict_json(F.col("right")).isNotNull()
    return durable(sections.withColumn("parses", F.coalesce(parses, F.lit(False))))


def flatten_documents(docs: DataFrame, column: str, id_cols: list[str]) -> DataFrame:
    """Rows (ids, path, kind, value, v) for every node of a JSON document; unparsable ones give none.

    Objects open level by level until none is left, anything else is a leaf and arrays stay whole.  ``path`` is an
    array of names, ``value`` the compact JSON of a leaf and ``v`` the node itself.
    """
    roots = docs.select(*id_cols, F.array().cast("array<string>").alias("path"), strict_json(F.col(column)).alias("v")).filter(
        "v IS NOT NULL")
    return expand_objects(roots, id_cols).withColumn("value", F.when(F.col("kind") == "leaf", leaf_json(F.col("v"))))


def merge_catalogs(left: DataFrame, right: DataFrame, id_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge two flattened documents node by node.

    Nodes of one side only are kept.  A node on both sides must be an object on both or the
    same leaf; the first that is not, in path order, is the document's conflict and the
    document is left out.  A conflict at the root is a conflict too.
    """
    at = [*id_cols, "path"]
    # Conflicts are on both sides, so their filter makes this an inner join.
    joined = left.withColumnsRenamed({"kind": "_lk", "value": "_lv", "v": "_l"}).join(
        shuffled(right.withColumnsRenamed({"kind": "_rk", "value": "_rv", "v": "_r"})), at, "full_outer")
    both = F.col("_lk").isNotNull() & F.col("_rk").isNotNull()
    differs = both & ((F.col("_lk") != F.col("_rk")) | (F.coalesce("_lv", F.lit("")) != F.coalesce("_rv", F.lit(""))))
    judged = joined.select(*at, F.coalesce("_lk", "_rk").alias("kind"), F.coalesce("_lv", "_rv").alias("value"),
                           F.when(F.col("_lk").isNotNull(), F.col("_l")).otherwise(F.col("_r")).alias("v"), differs.alias("_conflict"))
    conflicts = judged.filter("_conflict").groupBy(*id_cols).agg(F.min("path").alias("conflict_path"))
    merged = judged.join(shuffled(conflicts), id_cols, "left_anti").drop("_conflict")
    return merged, conflicts.withColumn("conflict_path", F.array_join("conflict_path", "."))


def merge_findings(sections: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Files that could not be merged: broken markers, a side that is no JSON, overlapping edits."""
    unparsable = sections.filter("not malformed and not parses")
    return union_diagnostics(
        diagnose(sections.filter("malformed"), "L10N_E0088", {"reason": F.lit("markers")}),
        diagnose(unparsable, "L10N_E0088", {"reason": F.lit("json")}),
        diagnose(conflicts, "L10N_E0088", {"conflict_path": F.col("conflict_path")}))


def merge_summary(sections: DataFrame, conflicts: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """Files scanned, merged and failed per project, and those that are ``rewritten`` (project, path) if given."""
    judged = sections.join(shuffled(conflicts.select("project", "path", F.lit(True).alias("_clash"))),
                           ["project", "path"], "left")
    fine = ~F.col("malformed") & F.col("parses") & F.col("_clash").isNull()
    counts = judged.groupBy("project").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("conflicted") & fine).alias("auto_merged"),
        F.count_if(~fine).alias("failed"))
    if rewritten is None:
        return counts
    changed = rewritten.groupBy("project").agg(F.count(F.lit(1)).alias("reformatted"))
    return counts.join(changed, "project", "left").withColumn("reformatted", F.coalesce("reformatted", F.lit(0)))
