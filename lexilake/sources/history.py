"""The append-only history log and the snapshots it points to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose, union_diagnostics
from lexilake.functions.text import is_blank
from lexilake.operators.rows import INSTANT
from lexilake.schemas import HISTORY
from lexilake.session import durable, shuffled
from lexilake.sources.documents import (
    all_values, is_integer, is_object, is_string, json_type, judged_once, members, once, parse_once,
)
from lexilake.sources.catalogs import judge
from lexilake.sources.members import DOCUMENT, keyed, of_documents, read_blocks, read_members

# The fields each operation carries besides id, actor and ts.
OP_FIELDS = {
    "init": ["summary"], "sync": ["summary"], "import": ["from"], "rename": ["before", "after"],
    "lint_fix": ["files_updated", "renames"], "delete": ["key"], "add_locale": ["locale"],
    "remove_locale": ["locale"], "repair": ["summary"], "rollback": ["to"],
}


def _good_row(v):
    good = is_object(v) & is_string(v, "$.id") & is_string(v, "$.actor") & is_string(v, "$.ts")
    good = good & F.try_variant_get(v, "$.ts", "string").rlike(INSTANT)
    op = F.try_variant_get(v, "$.op", "string")
    by_op = F.lit(False)
    for name, fields in OP_FIELDS.items():
        ok = F.lit(True)
        for field in fields:
            if field == "files_updated":
                ok = ok & is_integer(v, "$.files_updated")
            elif field == "renames":
                ok = ok & F.coalesce(json_type(v, "$.renames").startswith("ARRAY"), F.lit(False))
            else:
                ok = ok & is_string(v, f"$.{field}")
        by_op = F.when(op == name, ok).otherwise(by_op)
    return F.coalesce(good & by_op, F.lit(False))


def is_last_line(lines: DataFrame) -> DataFrame:
    """Mark the last non-empty line of each log and drop the empty ones after it.

    A grouped maximum joined back, not a window: one log may hold a large share of all lines.
    """
    last = lines.filter(F.col("line") != "").groupBy("project", "path").agg(F.max("line_no").alias("_last"))
    return lines.join(last, ["project", "path"]).filter(F.col("line_no") <= F.col("_last")).withColumn(
        "is_last", F.col("line_no") == F.col("_last")).drop("_last")


def parse_history_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the logs (project, path, line_no, line), with ``is_last`` or without.

    A last line that cannot be used is dropped with a warning: an append may have been cut
    short.  A bad line before it makes the whole log unusable.  Lines are parsed and judged
    once, and what all outputs read is stored.
    """
    parsed = parse_once(lines if "is_last" in lines.columns else is_last_line(lines), "_v", F.col("line"))
    blank = is_blank(F.col("line"))
    judged = durable(once(parsed, "good", _good_row(F.col("_v"))).select(
        "project", "path", "line_no", "is_last", "good", (~F.col("good") & ~blank | (blank & ~F.col("is_last"))).alias("bad"),
        F.when(F.col("good"), F.from_json("line", HISTORY)).alias("h")))
    bad = judged.filter("bad").drop("h")
    fatal = durable(bad.filter(~F.col("is_last")).groupBy("project", "path").agg(F.min("line_no").alias("line_no")))
    unusable = shuffled(fatal.select("project", "path"))
    rows = judged.filter("good").join(unusable, ["project", "path"], "left_anti").select("project", "path", "line_no", "h.*")
    return rows, union_diagnostics(
        diagnose(bad.filter("is_last").join(unusable, ["project", "path"], "left_anti"),
                 "L10N_E0078", {"line": F.col("line_no")}),
        diagnose(fatal, "L10N_E0062", {"line": F.col("line_no")}))


def document_lines(docs: DataFrame) -> DataFrame:
    """Documents as numbered lines, without the empty ones at their end; ``is_last`` marks the last."""
    lines = F.split(F.rtrim("text", F.lit("\n")), "\n", -1)
    return docs.filter(F.rtrim("text", F.lit("\n")) != "").select(
        "project", "path", F.size(lines).alias("_n"), F.posexplode(lines).alias("_pos", "line")).select(
        "project", "path", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line", (F.col("_pos") + 1 == F.col("_n")).alias("is_last"))


def file_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(project, path, line_no, line) of every file below ``path``, each read by as many tasks as it has blocks.

    A line's number is the lines of the blocks before its own, which are counted first, and its place in its block.
    """
    rows = read_blocks(spark, path, "\n", **options)
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    return rows.withColumn("_place", place).join(starts, ["path", "block"]).select(
        "project", "path", (F.col("_before") + F.col("_place")).alias("line_no"), F.col("text").alias("line"))


def read_history(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Logs of any size below ``path``; no file is read whole."""
    return parse_history_lines(file_lines(spark, path, **options))


def parse_snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history_id, project, path, content) of snapshot documents; the file name is the id."""
    v = F.col("v")
    text_or_null = lambda f: F.schema_of_variant(f).isin("STRING", "VOID")
    good = F.coalesce(is_integer(v, "$.version") & (F.try_variant_get(v, "$.version", "double") == 1)
                      & is_object(v, "$.files") & all_values(members(v, "$.files"), text_or_null), F.lit(False))
    judged = judged_once(once(parse_once(docs, "v", F.col("text")), "good", good), _files=F.when(
        F.col("good"), F.try_variant_get(v, "$.files", "map<string,string>")))
    history_id = F.regexp_extract("path", r"([^/]*?)(?:\.json)?\z", 1)
    rows = judged.filter("good").select(history_id.alias("history_id"), "project", F.explode("_files").alias("path", "content"))
    return rows, diagnose(judged.filter(~F.col("good")), "L10N_E0062")


def snapshot_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_snapshots``, of documents given as their members."""
    v, item = F.col("v"), F.col("_v")
    version = is_integer(v, "$.version") & (F.try_variant_get(v, "$.version", "double") == 1)
    docs = durable(of_documents(rows, version=version, files=is_object(v, "$.files")))
    items = durable(keyed(rows, docs, "files", F.struct(
        F.schema_of_variant(item).isin("STRING", "VOID").alias("ok"), F.try_variant_get(item, "$", "string").alias("content"))))
    judged = judge(docs, items, F.col("version") & F.col("files"))
    history_id = F.regexp_extract("path", r"([^/]*?)(?:\.json)?\z", 1)
    fine = items.join(judged.filter("good").select(*DOCUMENT), DOCUMENT).select(
        history_id.alias("history_id"), "project", F.col("key").alias("path"), "item.content")
    return fine, diagnose(judged.filter(~F.col("good")), "L10N_E0062")


def read_snapshots(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Snapshot documents of any size below ``path``."""
    return snapshot_members(read_members(spark, path, **options))
