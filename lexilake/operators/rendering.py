"""JSON documents as nodes, opened level by level, and back to canonical text, level by level from the deepest.

A document's nodes are rows, so its size is bounded by no parser of nodes and no recursion runs in any task: a pass
opens all objects (or arrays) of one depth, in every document at once, and passes go on until none is left.  Rendering
groups the texts of one depth by their parents.  Only the finished text of a document is one value of one row.

Canonical text has the names of an object in ICU order, two blanks a level, one item a line, numbers as JavaScript
writes them and a line feed at its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.functions.escape import json_string
from lexilake.session import durable, forget, shuffled
from lexilake.sources.documents import is_object, json_type, members

INDENT = "  "


def js_number(value: Column) -> Column:
    """A double as JavaScript writes it."""
    text = value.cast("string")
    size = F.abs(value)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0\z", "")
    exponent = F.substring_index(text, "E", -1).cast("int")
    plain = F.when(F.floor(value) == value, text.cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(text.cast("decimal(38,22)").cast("string"), r"\.?0+\z", ""))
    return F.when(value == 0, "0").when((size >= 1e21) | (size < 1e-6), F.concat(
        mantissa, F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string"))).otherwise(plain)


def leaf_json(v: Column) -> Column:
    """The compact JSON of a variant that is no object; arrays as they are, numbers in canonical form."""
    kind = json_type(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", json_string(F.try_variant_get(v, "$", "string"))).when(
        number, js_number(F.try_variant_get(v, "$", "double"))).otherwise(F.to_json(v))


def is_array(v: Column) -> Column:
    return F.coalesce(json_type(v).startswith("ARRAY"), F.lit(False))


def expand_objects(roots: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, path, kind, v) of every node of the objects in ``roots`` (ids, path, v): ``object`` or ``leaf``."""
    level, found = durable(roots.select(*ids, "path", "v")), []
    while True:
        opened = is_object(F.col("v"))
        found.append(level.select(*ids, "path", F.when(opened, "object").otherwise("leaf").alias("kind"), "v"))
        level = durable(level.filter(opened).select(*ids, "path", F.explode(members(F.col("v"), "$")).alias("_name", "_v")).select(
            *ids, F.array_append("path", F.col("_name")).alias("path"), F.col("_v").alias("v")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _expand_all(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, path, place, kind, text): the nodes with all that is inside their arrays.

    ``place`` is where an item of an array stands; its path ends in that number.
    """
    shaped = nodes.select(*ids, "path", F.lit(None).cast("int").alias("place"), "kind", "v")
    level, found = durable(shaped.filter("kind = 'leaf'").select(*ids, "path", "place", "v")), [
        shaped.filter("kind = 'object'").select(*ids, "path", "place", "kind", F.lit(None).cast("string").alias("text"))]
    while True:
        v = F.col("v")
        kind = F.when(is_array(v), "array").when(is_object(v), "object").otherwise("leaf")
        found.append(level.select(*ids, "path", "place", kind.alias("kind"), F.when(kind == "leaf", leaf_json(v)).alias("text")))
        items = level.filter(is_array(v)).select(*ids, "path", F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("place", "v")).select(
            *ids, F.array_append("path", F.col("place").cast("string")).alias("path"), "place", "v")
        fields = level.filter(is_object(v)).select(*ids, "path", F.explode(members(v, "$")).alias("_name", "_v")).select(
            *ids, F.array_append("path", F.col("_name")).alias("path"), F.lit(None).cast("int").alias("place"), F.col("_v").alias("v"))
        level = durable(items.unionByName(fields))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def render_documents(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, text): canonical documents from nodes (ids, path, kind, v), as ``expand_objects`` and merges make them."""
    rows = durable(_expand_all(nodes, ids).withColumn("depth", F.size("path")))
    depth = rows.agg(F.max("depth")).first()[0]
    done = None
    for d in range(depth if depth is not None else 0, -1, -1):
        here = rows.filter(F.col("depth") == d)
        if done is None:
            inside = here.withColumn("_body", F.lit(None).cast("string"))
        else:
            line = F.concat(F.lit(INDENT * (d + 1)), F.when(
                F.col("place").isNull(), F.concat(json_string(F.element_at("path", -1)), F.lit(": "))).otherwise(""), "text")
            name = F.element_at("path", -1)
            bodies = done.select(*ids, F.slice("path", 1, d).alias("path"), F.struct(
                "place", F.collate(name, "UNICODE").alias("order"), name.alias("name"), line.alias("line")).alias("item")).groupBy(
                *ids, "path").agg(F.array_join(F.array_sort(F.collect_list("item"))["line"], ",\n").alias("_body"))
            inside = here.join(shuffled(bodies), [*ids, "path"], "left")
        opened, closed = F.when(F.col("kind") == "object", "{").otherwise("["), F.when(F.col("kind") == "object", "}").otherwise("]")
        text = F.when(F.col("kind") == "leaf", F.col("text")).when(F.col("_body").isNull(), F.concat(opened, closed)).otherwise(
            F.concat(opened, F.lit("\n"), "_body", F.lit("\n" + INDENT * d), closed))
        below, done = done, durable(inside.select(*ids, "path", "place", text.alias("text")))
        if below is not None:
            forget(below)
    forget(rows)
    return done.select(*ids, F.concat("text", F.lit("\n")).alias("text"))
