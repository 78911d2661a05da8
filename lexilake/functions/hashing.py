"""Content hashes of source keys and mergeable fingerprints of whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexilake.functions.escape import json_string


def icu_sorted_names(names: Column) -> Column:
    """Names in the Unicode collation order that canonical documents use."""
    ordered = F.array_sort(F.transform(names, lambda n: F.collate(n, "UNICODE")))
    return F.transform(ordered, lambda n: n.cast("string"))


def _placeholder_json(name: Column, spec: Column, pad: str) -> Column:
    example = F.when(spec["example"].isNotNull(),
                     F.concat(F.lit(f'{pad}  "example": '), json_string(spec["example"]), F.lit(",\n")))
    return F.concat(
        F.lit(pad), json_string(name), F.lit(": {\n"),
        F.coalesce(example, F.lit("")),
        F.lit(f'{pad}  "type": '), json_string(spec["type"]), F.lit(f"\n{pad}}}"),
    )


def source_key_json(text: Column, description: Column, placeholders: Column, indent: int = 0) -> Column:
    """Canonical two-space JSON of one source key: sorted fields, absent description left out."""
    pad = " " * indent
    names = F.map_keys(placeholders)
    ordered = F.when(F.size(names) > 1, icu_sorted_names(names)).otherwise(names)
    inner = F.array_join(
        F.transform(ordered, lambda n: _placeholder_json(n, F.element_at(placeholders, n), pad + "    ")), ",\n")
    body = F.when(F.coalesce(F.size(placeholders), F.lit(0)) <= 0, F.lit("{}")).otherwise(
        F.concat(F.lit("{\n"), inner, F.lit(f"\n{pad}  }}")))
    described = F.when(description.isNotNull(),
                       F.concat(F.lit(f'{pad}  "description": '), json_string(description), F.lit(",\n")))
    return F.concat(
        F.lit("{\n"), F.coalesce(described, F.lit("")),
        F.lit(f'{pad}  "placeholders": '), body, F.lit(",\n"),
        F.lit(f'{pad}  "text": '), json_string(text), F.lit(f"\n{pad}}}"),
    )


def source_hash(text: Column, description: Column, placeholders: Column) -> Column:
    """``sha256:`` hash of the canonical document of one source key."""
    doc = F.concat(source_key_json(text, description, placeholders), F.lit("\n"))
    return F.concat(F.lit("sha256:"), F.sha2(doc, 256))


def set_fingerprint(row_hash: Column) -> Column:
    """Order-free fingerprint of a group of rows from their hex SHA-256 values.

    Eight 32-bit lanes are summed and hashed with the row count.  Sums combine map-side,
    so no task ever holds a whole catalog, which a hash of the rendered document would need.
    """
    hexes = F.right(row_hash, F.lit(64))
    lanes = [F.sum(F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
             for i in range(8)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *lanes), 256))


def history_id(ts: Column, suffix: Column) -> Column:
    """First 14 digits of the instant, a dash, a suffix: one-second resolution."""
    return F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-"), suffix)


def percent_complete(done: Column, total: Column) -> Column:
    """100 when nothing was planned, else the share done, at most 100, one decimal."""
    share = F.round(done.cast("double") / F.nullif(total, F.lit(0)) * 100, 1)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), share))
